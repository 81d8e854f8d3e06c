"""Quality classifier: Bradley-Terry ranking learnt from preference pairs, cut at a score quantile.

A document's strength is a linear function of features of its text. A document labelled 1 is preferred
to one labelled 0, with probability sigmoid(strength difference); the weights minimise the logistic loss
over all pairs of a labelled 1 and a labelled 0 document, on feature differences. A difference of two strengths
is needed for each pair only, so documents meet in narrow bins of their strength: no pair is listed, none is
left out, and a pass over the features of all labelled documents is a Newton step. The cut is the quantile of the strengths at the share of
label 0 among all usable labels, and the score is sigmoid(strength - cut + logit(threshold)), so that a
score reaches the threshold exactly at the cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import discard, held_out, materialise, read_table

#: Width of the bins of strength in which pairs are counted, and bins of a coarse one for second derivatives.
BIN, COARSE = 1 / 128, 16
#: Bins into which a bin that holds the cut is divided.
FINER = 4096
#: Of half the squared weights, against the mean loss of a pair.
PENALTY = 1e-3
THRESHOLD = 0.7
FEATURES = 18


def features(text: str | None) -> list[float]:
    """Features of a whole text; null and empty texts have zeros."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * FEATURES
    h = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x and not x.isspace()]
    n, nw = len(raw), max(1, len(words))
    low, up, wide = int(h[97:123].sum()), int(h[65:91].sum()), int(h[128:].sum())
    count = lambda chars: int(sum(h[ord(c)] for c in chars))
    same = sum(map(str.__eq__, words, words[1:]))
    doubled = text.count("!!") + text.count("??")
    shout = sum(map(str.isupper, words))
    return [
        up / (low + up + 1),
        shout / nw,
        count("0123456789") / n,
        math.sqrt(count("#*$%&<>~^@") / nw),
        math.sqrt(count("|") / nw),
        math.sqrt(doubled / nw),
        count("!?") / nw,
        count(".") / nw,
        count(",") / nw,
        count(";:()\"'-") / nw,
        wide / n,
        min(n / nw, 40.0) / 10,
        len(set(words)) / nw,
        math.sqrt(same / nw),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(nw) / 5,
        len(lines) / nw,
        1.0 if nw < 8 else 0.0,
    ]


@dataclass(frozen=True)
class QualityModel:
    mean: tuple
    scale: tuple
    weights: tuple
    cut: float
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - np.array(self.mean)) / np.array(self.scale) * np.array(self.weights)).sum(1)
        z = np.clip(raw - self.cut + math.log(self.threshold / (1 - self.threshold)), -35, 35)
        return 1 / (1 + np.exp(-z))


def _train_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, x): features of each row that isn't held out; they are far smaller than the texts, which don't move."""

    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["k", "x"])

    k = F.col(id_col)
    kept = docs.where(k.isNotNull() & ~held_out(k)).select(k.alias("k"), F.col(text_col).alias("t"))
    return kept.mapInArrow(run, T.StructType([kept.schema["k"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(b.column(0)), np.asarray(b.column(1).flatten()).reshape(-1, FEATURES)


def _moments(batches):
    """Rows of each class, mean and sum of squared deviations of the features of a task."""
    for b in batches:
        y, x = _rows(b)
        if len(y):
            v = np.concatenate([x.mean(0), ((x - x.mean(0)) ** 2).sum(0)])
            yield pa.RecordBatch.from_arrays([pa.array([int((y == c).sum())], pa.int64()) for c in (0, 1)] + [pa.array([v.tolist()], pa.list_(pa.float64()))], ["bad", "good", "v"])


def _standard(rows: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Rows of each class, means and deviations of all rows."""
    n, bad, good, mean, squares = 0, 0, 0, np.zeros(FEATURES), np.zeros(FEATURES)
    for r in rows.mapInArrow(_moments, "bad long, good long, v array<double>").toLocalIterator():
        m, v = r["bad"] + r["good"], np.array(r["v"])
        step = v[:FEATURES] - mean
        squares += v[FEATURES:] + step**2 * (n * m / (n + m))
        mean, n, bad, good = mean + step * (m / (n + m)), n + m, bad + r["bad"], good + r["good"]
    return bad, good, np.round(mean, 9), np.round(np.sqrt(squares / max(1, n)), 9) + 1e-6


def _emit(total: dict):
    if total:
        y, kind, at = zip(*total)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(kind, pa.int32()), pa.array(at, pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["y", "kind", "at", "v"])


def _binned(mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
    """Of all rows of a task by class: count and sum of features by bin of strength, sums of their products by coarse bin."""

    def run(batches):
        total: dict = {}
        for b in batches:
            ys, x = _rows(b)
            for y in (0, 1):
                z = (x[ys == y] - mean) / scale
                at = np.floor(z @ w / BIN).astype(np.int64)
                order = np.argsort(at, kind="stable")
                z, at = z[order], at[order]
                for kind, key in enumerate((at, at // COARSE)):
                    values, starts = np.unique(key, return_index=True)
                    for u, lo, hi in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(key)]):
                        v = (z[lo:hi].T @ z[lo:hi]).ravel() if kind else np.concatenate([[hi - lo], z[lo:hi].sum(0)])
                        total[y, kind, u] = total[y, kind, u] + v if (y, kind, u) in total else v
        yield from _emit(total)

    return run


def _merged(batches):
    total: dict = {}
    for b in batches:
        for y, kind, at, v in zip(*(c.to_pylist() for c in b.columns)):
            total[y, kind, at] = total[y, kind, at] + np.array(v) if (y, kind, at) in total else np.array(v)
    yield from _emit(total)


def _slopes(bins: list, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss over all pairs of a good and a bad row, its gradient and about its second derivative.

    A row takes part in its bin: all pairs of two bins have the difference of their mean strengths.
    """
    bins = sorted((r["y"], r["kind"], r["at"], r["v"]) for r in bins)
    side = [np.array([v for c, kind, _, v in bins if c == y and not kind]) for y in (0, 1)]
    (nb, xb), (ng, xg) = ((v[:, 0], v[:, 1:]) for v in side)
    sb, sg = xb @ w / nb, xg @ w / ng
    loss, cross = 0.0, np.zeros((FEATURES, FEATURES))
    wrong, slope = [np.zeros(len(nb)), np.zeros(len(ng))], [np.zeros(len(nb)), np.zeros(len(ng))]
    for i in range(0, len(ng), 256):
        cut = slice(i, i + 256)
        d = sg[cut, None] - sb[None, :]
        e = np.exp(-np.abs(d))
        loss += float(ng[cut] @ (np.log1p(e) + np.maximum(-d, 0)) @ nb)
        p = np.where(d > 0, e, 1.0) / (1 + e)
        q = e / (1 + e) ** 2
        wrong[1][cut], wrong[0] = p @ nb, wrong[0] + ng[cut] @ p
        slope[1][cut], slope[0] = q @ nb, slope[0] + ng[cut] @ q
        cross += xg[cut].T @ (q @ xb)
    gradient = xb.T @ wrong[0] - xg.T @ wrong[1]
    second = -cross - cross.T
    for y, n in enumerate((nb, ng)):
        coarse = np.array([at // COARSE for c, kind, at, _ in bins if c == y and not kind])
        values, inside = np.unique(coarse, return_inverse=True)
        weight = dict(zip(values.tolist(), np.bincount(inside, n * slope[y]) / np.bincount(inside, n)))
        second += sum(weight[at] * np.array(v).reshape(FEATURES, FEATURES) for c, kind, at, v in bins if c == y and kind)
    pairs = ng.sum() * nb.sum()
    return loss / pairs, gradient / pairs, second / pairs


def _weights(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights that minimise the penalised loss over all pairs, by Newton steps; a step that doesn't help is halved."""
    schema = "y int, kind int, at long, v array<double>"
    at, w, step, last = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES), math.inf
    for _ in range(40):
        parts = rows.mapInArrow(_binned(mean, scale, w), schema).repartition("y", "kind", "at").mapInArrow(_merged, schema)
        loss, gradient, second = _slopes(parts.collect(), w)
        loss += PENALTY * float(w @ w) / 2
        if loss > last + 1e-7:
            step = step / 2
        else:
            at, last = w, loss
            step = -np.linalg.solve(second + PENALTY * np.eye(FEATURES), gradient + PENALTY * w)
        w = at + step
        if np.abs(step).max() < 1e-4:
            break
    return np.round(w, 6)  # sums differ in their last digits with the order of tasks


def _levels(mean: np.ndarray, scale: np.ndarray, w: np.ndarray, lo: float, width: float, end: int | None):
    """Rows of each class, least and largest strength by bins of a width from lo on, of the first `end` bins."""

    def run(batches):
        for b in batches:
            y, x = _rows(b)
            s = (((x - mean) / scale) * w).sum(1)
            at = np.floor((s - lo) / width)
            if end is not None:
                at = np.clip(at, 0, end - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(y), pa.array(s)], ["at", "y", "s"])

    return run


def _cut(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, share_bad: float, bad: int, good: int) -> float:
    """Where the weight of the strengths of all rows reaches share_bad, halfway to the next one; each class has its share of the labels as weight.

    Found by counts in ever finer bins, since all strengths needn't fit into one place.
    """
    weight = lambda b, g: b * share_bad / bad + g * (1 - share_bad) / good
    lo, width, end, inside, above, before = 0.0, BIN, None, None, math.inf, (0, 0)
    while True:
        found = rows.mapInArrow(_levels(mean, scale, w, lo, width, end), "at long, y int, s double")
        if inside is not None:
            found = found.where(F.col("s").between(*inside))
        counts = found.groupBy("at").agg(F.count_if(F.col("y") == 0).alias("b"), F.count_if(F.col("y") == 1).alias("g"), F.min("s").alias("first"), F.max("s").alias("last"))
        counts = sorted(counts.collect(), key=lambda r: r["at"])
        for i, r in enumerate(counts):
            upto = before[0] + r["b"], before[1] + r["g"]
            if weight(*upto) >= share_bad - 1e-9 or i == len(counts) - 1:
                break
            before = upto
        above = counts[i + 1]["first"] if i + 1 < len(counts) else above
        if r["first"] == r["last"] or width < 1e-13:
            break
        inside, end = (r["first"], r["last"]), FINER
        lo, width = r["first"], (r["last"] - r["first"]) / FINER
    ended = weight(upto[0] - (r["b"] > 0), upto[1] - (r["b"] == 0)) < share_bad - 1e-9  # not amid equal strengths
    return (r["last"] + above) / 2 if ended and above < math.inf else r["last"]


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> QualityModel:
    """Learn from labels 0 and 1 of all documents that aren't held out.

    Null ids and labels are skipped, so are ids with both labels. The share of label 0 counts all labels.
    Without labels of both classes every score is the threshold.
    """
    usable = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
    usable = usable.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("k", "y")
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    rows = materialise(_train_features(docs, id_col, text_col).join(usable, "k").select("y", "x"), "features")
    bad, good, mean, scale = _standard(rows)
    w, cut = np.zeros(FEATURES), 0.0
    if bad and good:
        w = _weights(rows, mean, scale)
        cut = _cut(rows, mean, scale, w, counts[0] / (counts[0] + counts[1]), bad, good)
    discard(rows)
    return QualityModel(tuple(mean), tuple(scale), tuple(w), float(cut), threshold)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with out_col (a column of that name is replaced): the score of each whole text, 0 to 1.

    Null texts score as empty ones. All other columns pass through; an empty table stays empty.
    """
    kept = docs.drop(out_col)
    at = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(at).to_pylist()], dtype=float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(x))], [*b.schema.names, out_col])

    return kept.mapInArrow(run, schema)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    out = score_quality(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= model.threshold).cast("int").alias("predicted"))
