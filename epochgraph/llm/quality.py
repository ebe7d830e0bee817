"""A quality classifier by co-training of two views that exchange confident pseudo-labels.

The content view is a logistic model on hashed byte n-grams of the text. The metadata view is one on what a page tells about
itself without its wording: source, language, length, and counts of its layout (lines, repeated lines and words, capitals,
digits, signs). Both start from labelled documents; in each round each view labels all the unlabelled documents that it is sure of for the other.
On labelled documents that neither has seen both views are calibrated, and their calibrated log-odds are averaged.

Training uses a bounded hash sample of labelled documents. What the unlabelled ones teach is summed up where they are: in each round
executors score all of them, whole, and add up the gradient and curvature that those which one view is sure of have for the other's
model. So however many are exchanged, the driver gets sums of a fixed size, and fits each model to its labelled documents and to the
parabola that these sums describe, with a fixed weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import blocks, text_buffers

#: About so many labelled documents are learned from.
LABELLED = 4000
#: Rounds, the share of all documents that a view teaches of each class, the calibrated probability that they have at least, and what
#: all of them weigh against the labelled documents.
ROUNDS, SHARE, SURE, TAUGHT = 4, 0.025, 0.97, (1.4, 0.25)
#: Share of good documents that the threshold may cost at most, and the score from which a document always stays.
LOSS, ENOUGH = 0.005, 0.7
SOURCES, LANGUAGES, NUMBERS = 64, 16, 14
#: Documents that one step of training looks at together.
PART = 256
#: Bounds of a view's own log-odds between which documents that it is taught are put together.
MARGINS = (0.25, 0.5, 1, 2, 4)
#: Tasks that add up the sums of all others.
ADDERS = 16

_CLASSES = np.zeros((256, 5), bool)  # capitals, digits, signs, white space, line feeds
_CLASSES[65:91, 0] = _CLASSES[48:58, 1] = True
_CLASSES[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 2] = True
_CLASSES[[9, 10, 11, 12, 13, 32], 3] = _CLASSES[10, 4] = True


def layout(column: pa.Array) -> np.ndarray:
    """Twelve numbers on each text's shape; null texts count as empty."""
    data, offsets = text_buffers(column)
    n = len(column)
    sums, repeated, seen_before, stuttered = np.zeros((n, 5)), *np.zeros((3, n))
    for begin, end, rows, starts in blocks(data, offsets):
        if end == begin:
            continue
        part = data[begin:end]
        full = np.append(starts[1:], end) > starts
        for k in range(5):
            sums[rows[full], k] += np.add.reduceat(_CLASSES[part, k], (starts - begin)[full], dtype=np.int64)
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = data[a:b].tobytes()
        lines, words = text.split(b"\n"), text.split()
        repeated[r] = 1 - len(set(lines)) / len(lines)
        if words:
            seen_before[r] = 1 - len(set(words)) / len(words)
            stuttered[r] = sum(map(eq, words, words[1:])) / len(words)
    size = np.diff(offsets)
    whole = np.maximum(size, 1)
    gaps = sums[:, 3] + 1
    shares = sums / whole[:, None]
    return np.stack([np.log1p(size), np.log1p(sums[:, 4]), np.log1p(size / (sums[:, 4] + 1)), np.log1p(size / gaps), shares[:, 0], shares[:, 1], shares[:, 2], shares[:, 3], repeated, seen_before, stuttered, size == 0], 1)


def metadata(source: pa.Array, lang: pa.Array, n_chars: pa.Array, text: pa.Array) -> np.ndarray:
    """The metadata view's features; nulls are a value of their own."""
    n = len(text)
    out = np.zeros((n, SOURCES + LANGUAGES + NUMBERS))
    for column, first, room in ((source, 0, SOURCES), (lang, SOURCES, LANGUAGES)):
        names = column.to_pylist()
        place = {x: first + zlib.crc32(repr(x).encode()) % room for x in set(names)}
        out[np.arange(n), [place[x] for x in names]] = 1
    chars = np.array([-1 if x is None else x for x in n_chars.to_pylist()], float)
    out[:, -14] = np.log1p(np.maximum(chars, 0))
    out[:, -13] = chars < 0
    out[:, -12:] = layout(text)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Linear:
    """A logistic model on standardised dense features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights + self.bias


@dataclass
class Means:
    """Mean features of the documents labelled by the other view: of all of a class about which the own view is about as sure (see MARGINS)."""

    x: np.ndarray
    label: np.ndarray
    weight: np.ndarray

    def loss(self, x: np.ndarray, weights: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        """Value and gradient of the logistic loss over the means, as features ``x``; documents of a class count alike."""
        logit = x @ weights + bias
        error = (sigmoid(logit) - self.label) * self.weight
        return float((self.weight * (np.logaddexp(0, logit) - self.label * logit)).sum()), x.T @ error, float(error.sum())


def fit_dense(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.5, decay: float = 1e-3, means: Means | None = None) -> Linear:
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z, w, b = (x - mean) / scale, np.zeros(x.shape[1]), 0.0
    taught = (means.x - mean) / scale if means else None
    weight = balance(y)
    for _ in range(steps):
        error = (sigmoid(z @ w + b) - y) * weight
        slope, shift = z.T @ error / len(y) + decay * w, error.mean()
        if means:
            _, more, further = means.loss(taught, w, b)
            slope, shift = slope + more, shift + further
        w -= rate * slope
        b -= rate * shift
    return Linear(mean, scale, w, b)


def balance(y: np.ndarray) -> np.ndarray:
    """Weights that make both classes count alike."""
    positive = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    return np.where(y > 0.5, 0.5 / positive, 0.5 / (1 - positive))


def descended(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Where limited-memory quasi-Newton steps (Nocedal 1980) from ``x`` lead; ``loss`` gives value and gradient."""
    value, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, shares = slope.copy(), []
        for moved, bent in reversed(past):
            shares.append((moved @ way) / (moved @ bent))
            way -= shares[-1] * bent
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.sqrt(slope @ slope))
        for (moved, bent), share in zip(past, reversed(shares), strict=True):
            way += (share - (bent @ way) / (moved @ bent)) * moved
        step = 1.0
        while True:
            following = x - step * way
            value_there, slope_there = loss(following)
            if value_there <= value - 1e-4 * step * (slope @ way) or step < 1e-4:
                break
            step /= 2
        moved, bent = following - x, slope_there - slope
        if moved @ bent > 1e-12:
            past = [*past[1 - memory :], (moved, bent)]
        done = value - value_there < 1e-6 * abs(value)
        x, value, slope = following, value_there, slope_there
        if done:
            break
    return x


def scales(sample: ngrams.Sample) -> np.ndarray:
    """What each bucket's share is multiplied by: the inverse of its root mean square."""
    return 1 / np.sqrt(sample.squares() / max(1, len(sample.size)) + 1e-10)


def fit_sparse(sample: ngrams.Sample, first: int, y: np.ndarray, weight: np.ndarray, means: Means | None = None, begin: np.ndarray | None = None, steps: int = 60, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """A logistic model on bucket shares, scaled by ``scales``, from where the lessons were taken on.

    ``y`` and ``weight`` are of the sample's rows from ``first`` on. Steps run over views of the sample, PART rows at a time.
    """
    scale = scales(sample)
    weight = weight / max(1, np.count_nonzero(weight))
    taught = means.x * scale if means else None

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        narrow = (x[:-1] * scale).astype(np.float32)
        value, slope, shift = decay / 2 * float(x[:-1] @ x[:-1]), np.zeros(ngrams.BUCKETS), 0.0
        for i, j, ids, shares in sample.parts(first, PART):
            size = sample.size[i:j]
            full = size > 0
            logit = np.full(j - i, x[-1])
            if full.any():
                logit[full] += np.add.reduceat(shares * narrow[ids], (sample.start[i:j] - sample.start[i])[full])
            own, of = y[i - first : j - first], weight[i - first : j - first]
            value += float((of * (np.logaddexp(0, logit) - own * logit)).sum())
            error = (sigmoid(logit) - own) * of
            slope += np.bincount(ids, shares * np.repeat(error.astype(np.float32), size), ngrams.BUCKETS)
            shift += error.sum()
        slope = np.append(slope * scale + decay * x[:-1], shift)
        if means:
            more = means.loss(taught, x[:-1], x[-1])
            value, slope = value + more[0], slope + np.append(*more[1:])
        return value, slope

    x = descended(loss, np.zeros(ngrams.BUCKETS + 1) if begin is None else begin, steps)
    return x[:-1] * scale, float(x[-1])


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make the logit's sigmoid a calibrated probability."""
    model = fit_dense(logit[:, None], y, steps=300, decay=1e-2)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    slope = float(model.weights[0] / model.scale[0])
    return slope, float(model.bias - model.mean[0] * slope + np.log(prior / (1 - prior)))


#: Slope and shift of each view's log-odds.
Calibration = tuple[tuple[float, float], tuple[float, float]]


@dataclass
class Model:
    words: np.ndarray
    words_bias: float
    page: Linear | None
    calibration: Calibration
    least: float

    def combined(self, content: np.ndarray, page: np.ndarray) -> np.ndarray:
        """Probability of good quality from the two views' logits."""
        (a, b), (c, d) = self.calibration
        return sigmoid((a * content + b + c * page + d) / 2)


#: Of a round: the models so far, and from which calibrated log-odds on each view is sure of bad and of good, to what the content view and the metadata view are taught.
Teach = Callable[[np.ndarray, float, Linear, Calibration, np.ndarray], tuple[Means, Means]]


def sure_from(logits: list[np.ndarray], calibration: Calibration) -> np.ndarray:
    """The certainty (views x classes) that SHARE of the held documents, a sample of all, exceed, but no less than that of SURE."""
    odds = np.array([a * x + b for (a, b), x in zip(calibration, logits, strict=True)])
    most = np.quantile(np.stack([-odds, odds], 1), 1 - SHARE, axis=2)
    return np.maximum(most, np.log(SURE / (1 - SURE)))


def train(rows: list[tuple[object, int, bytes, bytes, bytes]], teach: Teach, seed: int = 5, rounds: int = ROUNDS) -> Model:
    """rows: (id, label, bucket ids, shares, page) of the labelled documents; labels are 1 good, 0 bad. A quarter is held for calibration."""
    order = np.random.default_rng(seed).permutation(len(rows)).tolist()
    held = len(rows) // 4
    rows = [rows[i] for i in order]  # those held come first, so that what is learned from is one run
    labels = np.array([r[1] for r in rows], float)
    sample, page = ngrams.Sample([r[2:4] for r in rows]), np.array([np.frombuffer(r[4]) for r in rows])
    rows.clear()  # the driver's memory is small
    own, scale = labels[held:], scales(sample)
    lessons: tuple[Means | None, Means | None] = (None, None)
    for r in range(rounds + 1):
        begin = np.append(content[0] / scale, content[1]) if r else None
        content = fit_sparse(sample, held, own, balance(own), lessons[0], begin)
        linear = fit_dense(page[held:], own, means=lessons[1])
        logits = [sample.times(np.arange(held), content[0][:, None])[:, 0] + content[1], linear.logit(page[:held])]
        calibration = ((1.0, 0.0), (1.0, 0.0)) if len(set(labels[:held].tolist())) < 2 else tuple(platt(x, labels[:held]) for x in logits)
        if r < rounds and held:
            lessons = teach(*content, linear, calibration, sure_from(logits, calibration))
    model = Model(*content, linear, calibration, 0.0)
    good = model.combined(*logits)[labels[:held] > 0.5]
    model.least = float(min(ENOUGH, np.quantile(good, LOSS))) if len(good) else 0.0
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """Learn from a hash sample of the labels and from all documents besides; of repeated labels the majority counts, ties and nulls teach nothing.

    Texts are read once for the labelled documents and once in each round.
    """
    rows = columns(docs, id_col, text_col).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    votes = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("label")).filter("label <> 0.5")
    votes = votes.filter(ngrams.share_hashed(votes, F.col("id"), labelled)).select("id", F.round("label").cast("int").alias("label"))
    chosen = rows.join(F.broadcast(votes), "id")  # about ``labelled`` rows
    kind = docs.schema[id_col].dataType.simpleString()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ngrams.counts(batch.column("text"), ngrams.SIGNS)
            page = metadata(*(batch.column(c) for c in ("source", "lang", "n_chars", "text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary()), pa.array([p.tobytes() for p in page], pa.binary())], names=["id", "label", "ids", "shares", "page"])

    got = chosen.mapInArrow(features, f"id {kind}, label int, ids binary, shares binary, page binary").dropDuplicates(["id"]).collect()
    got = sorted((tuple(r) for r in got), key=lambda r: (str(r[0]), r[2]))
    if not got:
        return Model(np.zeros(ngrams.BUCKETS), 0.0, None, ((1.0, 0.0), (1.0, 0.0)), 0.0)
    taken = docs.sparkSession.sparkContext.broadcast({r[0] for r in got})
    return train(got, lambda *models: taught(rows, taken, *models), rounds=rounds)


def taught(rows: DataFrame, taken: Broadcast, words: np.ndarray, bias: float, linear: Linear, calibration: Calibration, least: np.ndarray) -> tuple[Means, Means]:
    """What the content view and the metadata view are taught by the other, from all ``rows`` that aren't ``taken``.

    A view teaches a document if its calibrated odds are sure of the label (``least``, see ``sure_from``) and the other's are on the same side.
    Each task adds up its documents' features by class and margin, some 1.6 MB, and ADDERS tasks add these up.
    """
    (a, b), (c, d) = calibration
    widths, groups = (ngrams.BUCKETS, len(linear.mean)), 2 * (len(MARGINS) + 1)

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((2, groups)), [np.zeros((groups, w)) for w in widths]
        for batch in batches:
            text = batch.column("text")
            page = metadata(*(batch.column(x) for x in ("source", "lang", "n_chars", "text")))
            odds = np.stack([a * (ngrams.scores(text, ngrams.SIGNS, words[:, None])[:, 0] + bias) + b, c * linear.logit(page) + d])
            value = (odds > 0).astype(int)
            group = value * (groups // 2) + np.searchsorted(MARGINS, np.abs(odds))
            free = np.array([x not in taken.value for x in batch.column("id").to_pylist()], bool) & (value[0] == value[1])
            for view in (0, 1):
                sure = np.flatnonzero(free & (np.abs(odds[1 - view]) > least[1 - view][value[1 - view]]))
                n[view] += np.bincount(group[view][sure], minlength=groups)
                if view:
                    np.add.at(sums[1], group[1][sure], page[sure])
                    continue
                for i in range(0, len(sure), PART):
                    found = ngrams.counts(text.take(pa.array(sure[i : i + PART])), ngrams.SIGNS)
                    at = [np.frombuffer(x[0], np.uint16).astype(np.int64) + g * widths[0] for x, g in zip(found, group[0][sure[i : i + PART]].tolist(), strict=True)]
                    sums[0] += np.bincount(np.concatenate(at), np.concatenate([np.frombuffer(x[1], np.float32) for x in found]), sums[0].size).reshape(groups, -1)
        yield _row(np.concatenate([x.ravel() for x in (n, *sums)]))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for x in batch.column("sums"):
                total = total + np.frombuffer(x.as_buffer())
        if isinstance(total, np.ndarray):
            yield _row(total)

    found = rows.mapInArrow(one_pass, "sums binary").repartition(ADDERS).mapInArrow(added, "sums binary").collect()
    n, *sums = np.split(sum((np.frombuffer(r["sums"]) for r in found), np.zeros(groups * (2 + sum(widths)))), np.cumsum([2 * groups, groups * widths[0]]))
    labels = np.arange(groups) // (groups // 2)

    def means(view: int) -> Means:
        own = n.reshape(2, -1)[view]
        some = np.flatnonzero(own)
        whole = np.bincount(labels, own)
        return Means(sums[view].reshape(groups, -1)[some] / own[some, None], labels[some].astype(float), np.array(TAUGHT)[labels[some]] / 2 * own[some] / whole[labels[some]])

    return means(0), means(1)


def _row(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])


def columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns that the views read, null where the table has none."""
    other = [(docs[c] if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *other)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct (score, content, metadata, rejected): the combined probability of good quality and the two views' own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("score double, content double, metadata double, rejected boolean")
    def judged(text: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> pa.Array:
        of = shared.value
        content = ngrams.scores(text, ngrams.SIGNS, of.words[:, None])[:, 0] + of.words_bias
        page = of.page.logit(metadata(source, lang, n_chars, text)) if of.page else np.zeros(len(text))
        p = of.combined(content, page)
        (a, b), (c, d) = of.calibration
        return pa.StructArray.from_arrays([pa.array(x) for x in (p, sigmoid(a * content + b), sigmoid(c * page + d), p < of.least)], ["score", "content", "metadata", "rejected"])

    other = [(docs[c] if c in docs.columns else F.lit(None)).cast(t) for c, t in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    return judged(docs[text_col], *other)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score, content, metadata, rejected) of every row.

    Null texts count as empty, null metadata as a value of its own; repeated rows and null ids stay. Without any label every
    score is a half and nothing is rejected; an empty table gives an empty result. Texts of any length are read whole.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    found = docs.select(docs[id_col], score(docs, model, text_col).alias("found"))
    return found.select(id_col, "found.score", "found.content", "found.metadata", "found.rejected")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows that aren't rejected, with the columns they had."""
    return docs.filter(~score(docs, fit(docs, labels, id_col, text_col, label_col), text_col).getField("rejected"))
