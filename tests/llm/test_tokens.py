"""Counts, ids and packing against the tokenizers' libraries."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from epochgraph.llm import packing, token_count
from epochgraph.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(encoder, texts):
    out = [[] for _ in texts]
    for rows, ids, counts in encoder.encode(pa.array(texts, pa.string())):
        for r, part in zip(rows, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            out[r] += part.tolist()
    return out


def test_ids(library, odd_docs):
    rnd = random.Random(1)
    texts = [r["text"] for r in odd_docs.collect()] + ["".join(rnd.choice("aA.,'sSt<|>̱́ \n\t\x1c é1K") for _ in range(rnd.randrange(30))) for _ in range(5000)]
    texts += ["<|ENDOFTEXT|> H̱a İ ẞ. ΑΣ ΑΣ.", "abc. " * 300_000]
    assert ids_of(WordEncoder(PATH), texts) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name, chunk, overlap", [("word_bpe_49k.json", 300, 8), ("byte_bpe_50k.json", 600, 16), ("piece_bpe_32k.model", 600, 16)])
def test_chunks_resynchronise(documents, name, chunk, overlap):
    path = public_tokenizers.path(name)
    counter = token_count.Counter(path, chunk, overlap)
    texts = [r["text"] for r in documents.limit(150).collect()] + ["x" * 5000, "a b " * 2000, "é " * 3000, "\n" * 3000, "日本 語の\n文 " * 900, None, ""]
    if name.endswith("json"):
        model = Tokenizer.from_file(path)
        want = [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]
    else:
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])]
    assert counter.counts(pa.array(texts)).tolist() == want


def test_spans(library):
    """Each id with the bounds of its word, in characters, over a text of several blocks."""
    texts = ["", "Ab,  cd. é日 x", "été " * 700_000]
    for text, (ids, begins, ends) in zip(texts, WordEncoder(PATH).encode_with_spans(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert (begins < ends).all() and (np.diff(begins) >= 0).all() and not any(text[a:b].split() != [text[a:b]] for a, b in list(zip(begins.tolist(), ends.tolist(), strict=True))[-50:])


def test_chunks_cover(spark):
    for n in range(0, 90):
        bounds = token_count.chunks(n, 20, 6)
        assert bounds[0][0] == 0 and bounds[-1][1] == n and all(b - c == 6 for (_, b), (c, _) in zip(bounds, bounds[1:], strict=False))


def test_long_pieces():
    """A text beyond two blocks, cut into pieces of the capacity as the library's ids are."""
    text = "Some words, of all kinds. " * 110_000
    ids = [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1]
    got = list(packing.document_pieces(pa.array(["a", text, "b"]), packing.encoder(PATH), 4096, 1))
    assert [(p, s, n, c) for r, p, s, n, c in got if r == 1] == [(k, 4096 * k, len(part), zlib.crc32(np.array(part, "<u4"))) for k, part in enumerate(ids[i : i + 4096] for i in range(0, len(ids), 4096))]


def test_counts(library, odd_docs, spark):
    got = token_count.token_counts(odd_docs, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 2048) for r in odd_docs.collect())
    assert Counter(map(tuple, got.collect())) == want
    assert token_count.token_counts(odd_docs.limit(0), PATH).count() == 0


def check_packing(rows, docs, library, capacity):
    at, texts = {}, Counter()
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in at.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) <= capacity
    want = Counter()
    for r in docs:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r["doc_id"], i // capacity, i, len(part := ids[i : i + capacity]), zlib.crc32(part.tobytes())) for i in range(0, len(ids), capacity))
    texts.update((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert texts == want
    return len(at), sum(r["length"] for r in rows)


def test_packing(library, odd_docs, documents):
    for docs in (odd_docs, documents.select("doc_id", "text")):
        rows = packing.pack(docs, PATH).collect()
        n, tokens = check_packing(rows, docs.collect(), library, packing.CAPACITY)
        assert n <= -(-tokens // packing.CAPACITY) + 2
    assert packing.pack(odd_docs.limit(0), PATH).count() == 0
    rows = packing.pack(odd_docs, PATH, capacity=7).collect()
    check_packing(rows, odd_docs.collect(), library, 7)


@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    rnd = random.Random(seed)
    counts = Counter(min(4096, int(rnd.expovariate(1 / 900)) + 1) if seed % 2 else rnd.choice([4096, 2049, 1500, 1400, 1366, 1000, 3]) for _ in range(20_000))
    for large, groups in ((3, 32), (8, 16)):
        plan = packing.Plan(counts, 4096, large, groups)
        fill, given = np.zeros(plan.sequences, int), Counter()
        for size, rank, n, first, each, offset in plan.segments:
            assert given[size] == rank and (fill[first : first + n] == offset).all()
            fill[first : first + n] += each * size
            given[size] += n * each
        assert given == counts and fill.max() <= 4096 and fill.min() > 0
        assert len(plan.segments) < 8 * 4096
    bound = -(-sum(s * c for s, c in counts.items()) // 4096)
    if seed % 2:
        assert packing.Plan(counts).sequences <= 1.01 * bound + 2


def test_empty_plan():
    assert packing.Plan({}).sequences == 0 and packing.Plan({}).arrays().shape == (0, 6)
