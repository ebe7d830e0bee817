"""Co-training looks at every unlabelled document."""

import numpy as np
import pyarrow as pa

from epochgraph.llm import ngrams, quality


def test_all_sure_documents_teach(spark):
    """What the views teach each other, from all of 900 documents in several partitions, against plain sums over dense features."""
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abc \n"), rng.integers(0, 30))) for _ in range(900)]
    rows = spark.createDataFrame([(i, t, f"s{i % 3}", "en" if i % 2 else None, i) for i, t in enumerate(texts)], "id long, text string, source string, lang string, n_chars long").repartition(5)
    words = rng.normal(size=ngrams.BUCKETS) * 12
    table = rows.orderBy("id").toPandas()
    page = quality.metadata(*(pa.Array.from_pandas(table[c]) for c in ("source", "lang", "n_chars", "text")))
    linear = quality.Linear(page.mean(0), np.ones(94), rng.normal(size=94) * 0.5, 0.1)
    x, calibration, least = dense(texts, ngrams.SIGNS), ((0.7, 0.2), (1.3, -0.1)), np.array([[0.5, 0.8], [0.9, 0.3]])
    taken = set(range(0, 900, 7))
    got = quality.taught(rows, spark.sparkContext.broadcast(taken), words, 0.3, linear, calibration, least)
    odds = [0.7 * (x @ words + 0.3) + 0.2, 1.3 * linear.logit(page) - 0.1]
    for view, (features, means) in enumerate(zip((x, page), got, strict=True)):
        groups = {}
        for i in range(900):
            own, other = odds[view][i], odds[1 - view][i]
            if i not in taken and (own > 0) == (other > 0) and abs(other) > least[1 - view][int(other > 0)]:
                groups.setdefault((int(own > 0), sum(abs(own) > m for m in quality.MARGINS)), []).append(features[i])
        assert len(groups) > 6 and len(means.x) == len(groups)
        whole = [sum(len(g) for (v, _), g in groups.items() if v == value) for value in (0, 1)]
        for row, label, weight, ((value, _), members) in zip(means.x, means.label, means.weight, sorted(groups.items()), strict=True):
            assert label == value and np.allclose(row, np.mean(members, 0), atol=1e-5)
            assert np.isclose(weight, quality.TAUGHT[value] / 2 * len(members) / whole[value])


def plain_layout(text):
    data = text.encode()
    n, whole = len(data), max(1, len(data))
    kinds = [sum(b in kind for b in data) for kind in (range(65, 91), range(48, 58), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], [9, 10, 11, 12, 13, 32], [10])]
    lines, words = data.split(b"\n"), data.split()
    twice = 1 - len(set(words)) / len(words) if words else 0
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words) if words else 0
    return [np.log1p(n), np.log1p(kinds[4]), np.log1p(n / (kinds[4] + 1)), np.log1p(n / (kinds[3] + 1)), *(k / whole for k in kinds[:4]), 1 - len(set(lines)) / len(lines), twice, again, n == 0]


def test_layout():
    """Numbers on texts' shapes by plain counts: nulls, none, other scripts, and texts longer than several blocks."""
    texts = ["", None, "a", "A B\n\nA B\n12 -- ", "\t\x0b\x0c\r ", "日本語 été", "word Word 7, " * 100_000, "x" * 600_000, "one line\n" * 70_000]
    got = quality.layout(pa.array(texts))
    assert np.allclose(got, [plain_layout(t or "") for t in texts])
    page = quality.metadata(pa.array(["s", None] * 4 + ["s"]), pa.array([None] * 9, pa.string()), pa.array([5, None, -1] * 3, pa.int64()), pa.array(texts))
    assert np.allclose(page[:, -12:], got) and (page[:, : quality.SOURCES].sum(1) == 1).all() and (page[:, quality.SOURCES : -quality.NUMBERS].sum(1) == 1).all()
    assert np.allclose(page[:, -14], np.log1p([5, 0, 0] * 3)) and page[:, -13].tolist() == [0, 1, 1] * 3


def dense(texts, table):
    """Shares of each text's 2- to 4-grams in their buckets, n-gram by n-gram."""
    out = np.zeros((len(texts), ngrams.BUCKETS))
    for row, text in zip(out, texts, strict=True):
        data = table[np.frombuffer((text or "").encode(), np.uint8)].tolist()
        for i in range(len(data)):
            for n in ngrams.ORDERS:
                gram = data[i : i + n]
                if len(gram) < n or 32 in gram[1:-1] or gram == [32, 32]:
                    continue
                hashed = n * 0x9E3779B
                for k, byte in enumerate(gram):
                    hashed ^= int(ngrams._SALT[k][byte])
                row[hashed % ngrams.BUCKETS] += 1
        row /= max(1, row.sum())
    return out


def test_ngrams():
    """Counts and scores, for op5 and op7 alike, against a plain loop; one text is so long that it is cut."""
    rng = np.random.default_rng(4)
    texts = ["", None, "a", " ", "Two  words, 12 signs\n\tand more", "日本 été", "x" * 50, " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(60_000))]
    weights = rng.normal(size=(ngrams.BUCKETS, 3))
    for table in (ngrams.LETTERS, ngrams.SIGNS):
        want = dense(texts, table)
        for found, row in zip(ngrams.counts(pa.array(texts), table), want, strict=True):
            got = np.zeros(ngrams.BUCKETS)
            got[np.frombuffer(found[0], np.uint16)] = np.frombuffer(found[1], np.float32)
            assert np.allclose(got, row, atol=1e-7)
        assert np.allclose(ngrams.scores(pa.array(texts), table, weights), want @ weights, atol=1e-5)


def test_model_is_the_dense_one():
    """The sparse fit's gradient vanishes for the dense features of the same rows."""
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcde "), 40)) + ("zq" if i % 3 else "") for i in range(60)]
    y, weight = np.array([i % 3 > 0 for i in range(60)], float), np.ones(60)
    x = dense(texts, ngrams.SIGNS)
    w, b = quality.fit_sparse(ngrams.Sample(ngrams.counts(pa.array(texts), ngrams.SIGNS)), 0, y, weight, steps=400, decay=1e-2)
    error = (quality.sigmoid(x @ w + b) - y) / 60
    scale = 1 / np.sqrt((x**2).mean(0) + 1e-10)
    assert np.abs((x.T @ error) * scale + 1e-2 * w / scale).max() < 3e-3 and abs(error.sum()) < 1e-3
    assert ((x @ w + b > 0) == (y > 0)).mean() > 0.9


def test_scores_are_the_dense_ones(spark):
    """The scores of all documents from plain n-gram loops and the fitted model."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    table = docs.toPandas()
    content = dense(table["text"], ngrams.SIGNS) @ model.words + model.words_bias
    page = model.page.logit(quality.metadata(*(pa.Array.from_pandas(table[c]) for c in ("source", "lang", "n_chars", "text"))))
    want = dict(zip(table["doc_id"], model.combined(content, page), strict=True))
    got = docs.select("doc_id", quality.score(docs, model).alias("s")).select("doc_id", "s.score", "s.rejected").collect()
    assert all(abs(want[r["doc_id"]] - r["score"]) < 1e-5 and r["rejected"] == (r["score"] < model.least) for r in got)
