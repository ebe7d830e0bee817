"""Shortest paths against the library, and a unigram machine against all segmentations."""

import itertools
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from epochgraph.llm import sentence_piece as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids(library, odd_docs, documents):
    rnd = random.Random(2)
    texts = [r["text"] for r in odd_docs.collect()] + [r["text"] for r in documents.limit(100).collect()]
    texts += ["".join(rnd.choice("ab eE.,\n\t  ▁é日🙂thingre's12") for _ in range(rnd.randrange(40))) for _ in range(3000)]
    texts += ["a" + " " * k + "b" for k in range(60)] + [" " * k for k in range(60)] + ["<s></s><unk><0x0A>"]
    out = [[] for _ in texts]
    for rows, ids, counts, *_ in sp.Codec(PATH).encode(pa.array(texts, pa.string())):
        for r, part in zip(rows, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            out[r] += part.tolist()
    assert out == [library.encode(t or "") for t in texts]


def test_frames(library, odd_docs):
    docs = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    tokens = sp.encoded(odd_docs, PATH)
    assert all(r["ids"] == library.encode(docs[r["doc_id"]]) for r in tokens.collect())
    for r in sp.decoded(tokens, PATH).collect():
        assert r["text"] == docs[r["doc_id"]].replace("▁", " ")
    trips = sp.round_trips(odd_docs, PATH).collect()
    assert len(trips) == odd_docs.count()
    for r in trips:
        assert r["n_tokens"] == len(library.encode(docs[r["doc_id"]])) and r["round_trip"] == ("▁" not in docs[r["doc_id"]])
    assert sp.round_trips(odd_docs.limit(0), PATH).count() == 0


def message(number, payload):
    return bytes([number << 3 | 2, len(payload)]) + payload


def test_unigram():
    rnd = random.Random(3)
    pieces = {"".join(p): round(-rnd.random() * 9, 3) for n in (1, 2, 3) for p in itertools.product("▁ab", repeat=n) if rnd.random() < 0.6 and "▁" not in "".join(p)[1:]} | {"▁": -5.0, "a": -4.0}
    model = message(1, message(1, b"<unk>") + b"\x18\x02")
    for p, s in pieces.items():
        model += message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s))
    model += message(2, b"\x18\x01") + message(3, message(1, b"identity") + b"\x18\x01\x20\x00")
    machine = sp.Machine(model)
    unknown = min(pieces.values()) - sp.UNKNOWN_PENALTY

    def best(word):
        cuts = itertools.product((0, 1), repeat=len(word) - 1)
        splits = ([word[i:j] for i, j in itertools.pairwise([0, *(k + 1 for k, c in enumerate(cut) if c), len(word)])] for cut in cuts)
        return max(sum(pieces.get(p, unknown) for p in s) for s in splits if all(p in pieces or len(p) == 1 for p in s))

    for _ in range(200):
        word = "▁" + "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9)))
        assert sum(pieces.get(p, unknown) for p in machine.path(word)) == pytest.approx(best(word), abs=1e-4)


def test_long_text(library, spark):
    """A text of several blocks, encoded and decoded."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé日🙂.,") for _ in range(rnd.randrange(1, 9))) for _ in range(4000)]
    text = " ".join(rnd.choice(words) + rnd.choice(["", "", "\n", "  "]) for _ in range(150_000))
    (row,) = sp.encoded(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).collect()
    assert row["ids"] == library.encode(text)
    (trip,) = sp.round_trips(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).collect()
    assert trip["round_trip"] and trip["decoded_bytes"] == len(text.encode())
