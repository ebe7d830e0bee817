"""Language identification by averaged hashed subword embeddings and a linear softmax, trained by SGD, with calibrated rejection.

A text is the mean of the embeddings of its byte n-grams (inside words, letters lowered), which a linear layer turns into one
logit a language. It is trained in numpy on a bounded hash sample of labelled texts. A part of the sample that training does not
see sets the softmax's temperature and the least confidence: texts below it, and those without any letter, are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams

#: About so many labelled texts are learned from.
SAMPLE = 2500
DIMENSIONS, EPOCHS, BATCH, RATE = 12, 12, 32, 20.0
#: Share of correctly labelled texts that rejection may cost at most.
LOSS = 0.002
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket embeddings times the linear layer
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def confidences(self, means: np.ndarray) -> np.ndarray:
        return softmax((means + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(sample: ngrams.Sample, labels: np.ndarray, languages: list[str], seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    embed = rng.normal(0, 1, (ngrams.BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    steps = EPOCHS * -(-len(used) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(used)
        for k in range(0, len(used), BATCH):
            rows = used[k : k + BATCH]
            row, bucket, share = sample.of(rows)
            x = np.stack([np.bincount(row, share * embed[bucket, d], len(rows)) for d in range(DIMENSIONS)], 1)
            error = softmax(x @ layer + bias)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            rate = RATE * (1 - step / steps)
            back = error @ layer.T
            layer -= rate * x.T @ error
            bias -= 0.05 * rate * error.sum(0)
            for d in range(DIMENSIONS):
                embed[:, d] -= rate * np.bincount(bucket, share * back[row, d], ngrams.BUCKETS)
            step += 1
    model = Model(languages, embed @ layer, bias)
    if len(held):
        means = sample.times(held, model.weights)
        losses = {}
        for t in np.geomspace(0.05, 20, 60):
            model.temperature = float(t)
            losses[float(t)] = -np.log(model.confidences(means)[np.arange(len(held)), labels[held]] + 1e-9).mean()
        model.temperature = min(losses, key=losses.get)
        found = model.confidences(means)
        right = found.argmax(1) == labels[held]
        if right.any():
            model.least = float(min(0.5, np.quantile(found[right].max(1), LOSS)))
    return model


def held_out(id_col: str) -> Column:
    """Whether crc32(id as text) mod 3 is 1; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` distinct labelled texts outside the held-out third; rows with nulls teach nothing."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col, text_col, lang_col)
    chosen = rows.filter(ngrams.share_hashed(rows.select(id_col), F.col(id_col), sample))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ngrams.counts(batch.column(1), ngrams.LETTERS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["id", "lang", "ids", "shares"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = chosen.mapInArrow(features, f"id {kind}, lang string, ids binary, shares binary").dropDuplicates(["id"]).collect()
    got = sorted((r for r in got if len(r["ids"])), key=lambda r: (str(r["id"]), r["lang"], bytes(r["ids"])))
    languages = sorted({r["lang"] for r in got})
    if not languages:
        return Model([], np.zeros((ngrams.BUCKETS, 1)), np.zeros(1))
    return train(ngrams.Sample([(r["ids"], r["shares"]) for r in got]), np.array([languages.index(r["lang"]) for r in got]), languages)


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(column.fill_null(""), r"\pL").to_numpy(zero_copy_only=False)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct (lang_pred, score, rejected) from the text alone; ``und`` and score 0 if it is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def judged(text: pa.Array) -> pa.Array:
        of = shared.value
        known = has_letter(text) & bool(of.languages)
        found = of.confidences(ngrams.scores(text, ngrams.LETTERS, of.weights))
        names = np.array([*of.languages, UNKNOWN], object)[np.where(known, found.argmax(1), len(of.languages))]
        score = np.where(known, found.max(1), 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(~known | (score < of.least))], ["lang_pred", "score", "rejected"])

    return judged(F.col(text_col))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) of every row; repeated rows and null ids stay, an empty table gives none.

    Texts that are null or have no letter are ``und`` with score zero, and so is everything if no row has a language to learn from. Texts of
    any length are read whole; columns other than the three named are not looked at.
    """
    model = fit(docs, id_col, text_col, lang_col)
    found = docs.select(id_col, held_out(id_col).alias("held_out"), predict(docs, model, text_col).alias("found"))
    return found.select(id_col, "held_out", "found.lang_pred", "found.score", "found.rejected")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is told with enough confidence, with the columns they had."""
    model = fit(docs, id_col, text_col, lang_col)
    return docs.filter(~predict(docs, model, text_col).getField("rejected"))
