"""Quality of a text: a linear support vector machine on n-gram indicators scaled by their naive Bayes log-count ratios.

N-grams are character 3-grams, 4-grams of character shapes (letter case, digit, gap, the mark itself) and, so that texts
that repeat themselves show whatever their words are, 4-grams of words reduced to which of the four are equal. An
indicator is scaled by the log ratio of its smoothed counts in the two classes and the vector has length one. Dual
coordinate descent fits the hinge loss; a sigmoid fitted on a kept-aside part of the bounded sample makes scores.

Defined cases: null and empty texts have no n-grams and get the score of the bias; null labels teach nothing; without
labels of both classes every score is the share of label 1 (0.5 without any); repeated rows are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import SAMPLE_ROWS, held_out, sampled
from .textblocks import U, blocks, lists, span_hash, spread, text_bytes, words

BITS = 17
SIZE = 2 * (1 << BITS) + 64
#: Cost of a violated margin, passes and smoothing of the fit.
COST, PASSES, SMOOTH = 1.0, 15, 1.0
THRESHOLD = 0.7

SHAPE = np.full(256, 1, np.uint8)
SHAPE[:128] = [{True: 1}.get(chr(c).islower(), 2 if chr(c).isupper() else 3 if chr(c).isdigit() else 5 if c == 10 else 4 if chr(c).isspace() else 6 + c % 58) for c in range(128)]


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of a block, ascending."""
    rows, size = np.arange(len(at) - 1), np.diff(at)
    keys = []
    for base, code, shift, n in ((0, data, 8, 3), (1 << BITS, SHAPE[data], 6, 4)):
        key = np.zeros(len(code), np.uint32)
        for i in range(n):
            key[:len(code) - i] = (key[:len(code) - i] << np.uint32(shift)) | code[i:]
        bucket = (((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(U)) + U(base)
        k = np.maximum(0, size - n + 1)
        keys.append((np.repeat(rows, k).astype(U) << U(20)) | bucket[spread(at[:-1], k)])
    start, end, row = words(data, at)
    h = span_hash(data, start, end)
    m = len(h) - 3
    if m > 0:
        code = np.zeros(m, np.int64)
        for bit, (i, j) in enumerate(((0, 1), (1, 2), (2, 3), (0, 2), (1, 3), (0, 3))):
            code |= (h[i:i + m] == h[j:j + m]).astype(np.int64) << bit
        inside = np.flatnonzero(row[3:] == row[:m])
        keys.append((row[inside].astype(U) << U(20)) | (code[inside] + (2 << BITS)).astype(U))
    found = np.sort(np.concatenate(keys))
    found = found[np.append(True, found[1:] != found[:-1])] if len(found) else found
    return (found >> U(20)).astype(np.int64), (found & U((1 << 20) - 1)).astype(np.int64)


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int) -> np.ndarray:
    """Weights and bias that minimise |w|^2 / 2 + COST * hinge losses; classes weigh alike."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    most = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * COST
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        for k in order.permutation(len(rows)):
            i, x = rows[k]
            g = y[k] * (x @ w[i] + w[-1]) - 1
            new = min(max(alpha[k] - g / (x @ x + 1), 0.0), most[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * y[k]
                w[i] += step * x
                w[-1] += step
                alpha[k] = new
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a margin + b))) by Newton steps with smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        hess = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit_rows(found: list[tuple[np.ndarray, int]]) -> dict:
    """The model from (features, label 0/1) rows in a fixed order."""
    labels = np.array([label for _, label in found], np.int64)
    teach = np.arange(len(found)) % 4 != 0
    y = np.where(labels > 0, 1, -1)
    if len(set(y[teach])) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        return {"ratio": np.zeros(SIZE), "weights": np.zeros(SIZE), "a": 0.0, "b": float(np.log((share + 1e-3) / (1 - share + 1e-3))), "bias": 0.0}
    up, down = np.full(SIZE, SMOOTH), np.full(SIZE, SMOOTH)
    for k in np.flatnonzero(teach):
        (up if y[k] > 0 else down)[found[k][0]] += 1
    ratio = np.log((up / up.sum()) / (down / down.sum()))
    rows = []
    for i, _ in found:
        x = ratio[i]
        rows.append((i, x / max(1e-12, np.sqrt(x @ x))))
    own = np.flatnonzero(teach)
    w = dual_coordinate_descent([rows[k] for k in own], y[own], SIZE)
    aside = np.flatnonzero(~teach)
    margin = np.array([x @ w[i] + w[-1] for i, x in (rows[k] for k in aside)])
    a, b = sigmoid_fit(margin, y[aside]) if len(aside) else (1.0, 0.0)
    return {"ratio": ratio, "weights": w[:-1] * ratio, "a": a, "b": b, "bias": float(w[-1])}


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> dict:
    """Fits on at most about ``sample_rows`` labelled rows of each class; their ids are broadcast (that many at most)."""
    may = labels.filter(~held_out(id_col) & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.when(F.col(label_col) > 0, 1).otherwise(0).cast("long").alias("__label")).dropDuplicates(["__id"])
    some = sampled(may, "__label", F.col("__id"), sample_rows)
    rows = df.join(F.broadcast(some), F.col(id_col) == F.col("__id")).select(F.col(text_col).cast("string"), "__label", F.xxhash64("__id", text_col).alias("salt"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(0))
            for lo, hi in blocks(at, 1 << 20):
                row, f = features(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                cut = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=hi - lo))))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), lists(f, cut, pa.int32())], ["label", "salt", "f"])

    names = ["ratio", "weights", "a", "b", "bias"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            for i in range(b.num_rows):
                found.append((b.column(1)[i].as_py(), b.column(0)[i].as_py(), np.asarray(b.column(2)[i].values).astype(np.int64)))
        found.sort(key=lambda r: (r[0], r[1], len(r[2])))
        m = fit_rows([(f, label) for _, label, f in found])
        yield pa.RecordBatch.from_arrays([pa.array([m[k].tobytes()], pa.binary()) if k in ("ratio", "weights") else pa.array([m[k]], pa.float64()) for k in names], names)

    got = rows.mapInArrow(make, "label long, salt long, f array<int>").repartition(1).mapInArrow(fit, "ratio binary, weights binary, a double, b double, bias double").collect()
    if not got:
        return fit_rows([])
    return {k: np.frombuffer(bytes(v)) if k in ("ratio", "weights") else v for k, v in zip(names, got[0])}


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row; only the text is looked at."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        squared = m["ratio"] ** 2
        for b in batches:
            data, at = text_bytes(b.column(1))
            for lo, hi in blocks(at, 1 << 20):
                row, f = features(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                dot = np.bincount(row, weights=m["weights"][f], minlength=hi - lo)
                norm = np.sqrt(np.bincount(row, weights=squared[f], minlength=hi - lo))
                margin = dot / np.maximum(1e-12, norm) + m["bias"]
                p = 1 / (1 + np.exp(-np.clip(m["a"] * margin + m["b"], -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p)], ["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def rate(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, **params) -> DataFrame:
    """id, held_out, score, predicted (1 from ``threshold`` on) of each row."""
    told = score(df, train(df, labels, id_col, text_col, label_col, **params), id_col, text_col)
    return told.select(id_col, held_out(id_col).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
