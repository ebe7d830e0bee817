import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from support import SF  # noqa: E402

ODD = ["", None, " ", "\n", "a", "one two", "x" * 3000, "été ÉTÉ É", "日本語 テスト。", "🙂 a.", "<|endoftext|> it's", "<|im_start|>a<|im_end|>", "▁▁ ▁x", "tab\tand\x0bmore\x0c", "a.\n\nb,  c", "12.5 %%% $$$"]
LONG = "word and more, of it. " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, a very long one, repeated rows, a null id, and columns with clashing names."""
    texts = [*ODD, LONG, LONG + "end", "same text here"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", None if i % 5 == 0 else len(t or ""), "clash", 1.5) for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "no id here at all", None, None, None, None, None), (999, "same text here", "en", "s0", 14, "", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score double")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
