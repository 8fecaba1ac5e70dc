"""Quality classifier: naive-Bayes features in a linear support vector machine.

Binary n-gram indicators are scaled by the log-count ratio of the two classes; a linear hinge-loss model over them is fit
by dual coordinate descent; a logistic curve through cross-validated margins turns a margin into a score.

N-grams, all hashed into fixed ranges: three bytes of the text, one and two words, and one to three word shapes (case,
last sign, length class, and whether the word repeats the one before).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import string_buffers, text_slices
from .words import mix, scan, span_hashes

BYTE_BITS, WORD_BITS, SHAPE_BITS = 15, 17, 13
N_FEATURES = (1 << BYTE_BITS) + (1 << WORD_BITS) + (1 << SHAPE_BITS)
#: Bytes of text whose features are made at once.
SLICE = 1 << 20
#: The model is fit on at most so many labelled documents, chosen by a seeded hash of doc_id.
MAX_FIT_ROWS = 2500
THRESHOLD = 0.3
FOLDS = 3

_KIND = np.zeros(256, np.int64)  # class of a byte for word shapes
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 4
_KIND[[ord(c) for c in ".,;:"]] = 5
_KIND[[ord(c) for c in "!?"]] = 6
_KIND[[ord(c) for c in "#*$%&|<>"]] = 7


def _fold(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def ngram_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram occurrence, features of a row not yet distinct."""
    rows, features = [], []
    d = data.astype(np.uint64)
    if len(d) >= 3:
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = row[2:] == row[:-2]
        gram = (d[:-2] << np.uint64(16)) | (d[1:-1] << np.uint64(8)) | d[2:]
        rows.append(row[2:][inside])
        features.append(_fold(gram[inside], BYTE_BITS))
    w = scan(data, offsets)
    if len(w.starts):
        h = span_hashes(data, w.starts, w.ends)
        first, last, length = _KIND[data[w.starts]], _KIND[data[w.ends - 1]], w.ends - w.starts
        second = _KIND[data[np.minimum(w.starts + 1, w.ends - 1)]]
        joined = np.append(False, w.rows[1:] == w.rows[:-1])
        repeat = joined & np.append(False, h[1:] == h[:-1])
        shape = (((first * 8 + second) * 8 + last) * 5 + np.minimum(np.log2(length).astype(np.int64), 4)) * 2 + repeat
        shape = shape.astype(np.uint64) + np.uint64(1)
        base = 1 << BYTE_BITS
        rows += [w.rows, w.rows[joined]]
        features += [base + _fold(h, WORD_BITS), base + _fold(h[:-1][joined[1:]] * np.uint64(31) + h[joined], WORD_BITS)]
        base += 1 << WORD_BITS
        two = shape[:-1] * np.uint64(10007) + shape[1:] + (np.uint64(1) << np.uint64(40))
        three = two[:-1] * np.uint64(10007) + shape[2:] + (np.uint64(1) << np.uint64(41)) if len(shape) > 2 else two[:0]
        both = joined[1:][:-1] & joined[2:] if len(shape) > 2 else joined[:0]
        rows += [w.rows, w.rows[joined], w.rows[2:][both]]
        features += [base + _fold(shape, SHAPE_BITS), base + _fold(two[joined[1:]], SHAPE_BITS), base + _fold(three[both], SHAPE_BITS)]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(features)


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, edges): the distinct features of row i are features[edges[i]:edges[i + 1]]."""
    n = len(offsets) - 1
    row, feature = ngram_rows(data, offsets)
    order = np.argsort(row, kind="stable")
    row, feature = row[order], feature[order]
    cuts = np.searchsorted(row, np.arange(n + 1))
    seen = np.zeros(N_FEATURES, dtype=bool)
    out = []
    for i, j in zip(cuts.tolist(), cuts.tolist()[1:]):
        f = feature[i:j]
        if j - i > 20_000:
            seen[f] = True
            f = np.flatnonzero(seen)
            seen[f] = False
        else:
            f = np.unique(f)
        out.append(f)
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.append(0, np.cumsum([len(f) for f in out])).astype(np.int64)


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 6, seed: int = 1) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear hinge-loss model by dual coordinate descent.

    Row i has the value scale[f] / norm for each of its features f; cost[i] bounds its dual variable.
    """
    w, bias = np.zeros(len(scale)), 0.0
    norms = np.array([np.sqrt(v @ v) for v in (scale[f] for f in rows)])
    norms[norms == 0] = 1.0
    square = np.array([v @ v + 1.0 for v in (scale[f] / n for f, n in zip(rows, norms))])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            # a row's values are made anew: all rows' together would take more than their features
            f = rows[i]
            v = scale[f] / norms[i]
            gradient = y[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of the classes' smoothed shares of each indicator."""
    p, q = np.ones(N_FEATURES), np.ones(N_FEATURES)
    for f, label in zip(rows, y):
        (p if label > 0 else q)[f] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + level))), margin over the row's features of norm 1."""

    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    level: float

    def margins(self, features: np.ndarray, edges: np.ndarray) -> np.ndarray:
        s = self.scale[features]
        total, square = (np.append(0.0, np.cumsum(x, dtype=np.float64)) for x in (s * self.weights[features], s * s))
        norm = np.sqrt(np.maximum(square[edges[1:]] - square[edges[:-1]], 0))
        return np.where(norm > 0, (total[edges[1:]] - total[edges[:-1]]) / np.where(norm > 0, norm, 1), 0.0) + self.bias

    def scores(self, features: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(features, edges) + self.level, -500, 500)))


def _logistic(m: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and level of a logistic curve through margins, by Newton steps on smoothed targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    t = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([(p - t) @ m, (p - t).sum()])
        r = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(r * m) @ m + 1e-6, r @ m], [r @ m, r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model of label 1 against label 0. With labels of one class only (or none) every text scores that class's share."""
    y = np.where(labels > 0, 1.0, -1.0)
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    if not n1 or not n0:
        share = (n1 + 1) / (n1 + n0 + 2)
        return Model(np.zeros(N_FEATURES), np.zeros(N_FEATURES), 0.0, 1.0, float(np.log(share / (1 - share))))

    def train(index: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        some, label = [rows[i] for i in index], y[index]
        scale = log_ratios(some, label)
        share = np.array([len(label) / (2 * max(1, (label == s).sum())) for s in label])
        return scale, *fit_hinge(some, label, scale, 10 * share)

    margins, fold = np.zeros(len(y)), np.arange(len(y)) % FOLDS
    if len(y) >= 2 * FOLDS:
        for k in range(FOLDS):
            inner = np.flatnonzero(fold != k)
            outer = np.flatnonzero(fold == k)
            scale, w, b = train(inner)
            part = Model(scale, w, b, 1, 0)
            margins[outer] = part.margins(np.concatenate([rows[i] for i in outer]), np.append(0, np.cumsum([len(rows[i]) for i in outer])))
    scale, w, b = train(np.arange(len(y)))
    if len(y) < 2 * FOLDS:
        margins = Model(scale, w, b, 1, 0).margins(np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows])))
    return Model(scale, w, b, *_logistic(margins, y > 0))


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, seed: int = 7) -> Model:
    """Fit on the labelled documents that are not held out, at most max_rows of them, the first by a seeded hash of doc_id.

    Rows with a null doc_id or label are left out; of several labels of a document the smallest counts, and of rows that share
    a doc_id the smallest text.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_label")).dropna()
    marks = marks.where(~held_out()).groupBy("doc_id").agg(F.min("_label").alias("_label"))
    # a document that isn't in docs (an earlier stage dropped it) takes no place in the sample
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    chosen = marks.join(there, "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, SLICE):
                f, edges = indicators(*string_buffers(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(f, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_label"), lists], ["doc_id", "_label", "f"])

    # at most max_rows rows of two numbers; of rows that share a doc_id the smallest text counts, so the sample is bounded
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text")).select("doc_id", "text", "_label").mapInArrow(extract, "doc_id long, _label int, f array<int>")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got).sort_by([("doc_id", "ascending")])
            m = fit([x.values.to_numpy() for x in table["f"]], table["_label"].to_numpy())
            yield pa.RecordBatch.from_pydict({"scale": [m.scale.tobytes()], "weights": [m.weights.tobytes()], "bias": [m.bias], "slope": [m.slope], "level": [m.level]})

    # the bounded sample is fit in one task; the driver gets the model alone
    found = sample.coalesce(1).mapInArrow(train, "scale binary, weights binary, bias double, slope double, level double").collect()
    if not found:
        return fit([], np.zeros(0))
    r = found[0]
    return Model(np.frombuffer(r["scale"]), np.frombuffer(r["weights"]), r["bias"], r["slope"], r["level"])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= THRESHOLD). A null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, SLICE):
                score = shared.value.scores(*indicators(*string_buffers(part.column("text"))))
                predicted = pa.array((score >= THRESHOLD).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), predicted], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_predicted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents predicted to have label 1, with all their columns as they are. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, SLICE):
                yield part.filter(pa.array(shared.value.scores(*indicators(*string_buffers(part.column("text")))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
