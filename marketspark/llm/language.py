"""Language of a text: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL-proximal.

Features are the character 1- to 3-grams of the lower-cased letters (everything else is one kind of gap), hashed, with
their share of the text's n-grams times their inverse document frequency over all rows that may teach. The regularised
leader keeps a sum of gradients for each weight, an L1 threshold that leaves most weights at zero and an L2 term. One part
of the bounded sample is kept aside and sets the temperature that divides the scores.

Defined cases: null texts and texts without a letter are ``und`` with score 0; null labels teach nothing; without any label
every text is ``und``; repeated rows are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import SAMPLE_ROWS, held_out, sampled
from .textblocks import U, blocks, lists, spread, text_bytes

BITS = 16
ORDERS = (1, 2, 3)
#: Learning rate, its offset, L1, L2 and passes of the fit; scale of the features.
ALPHA, BETA, L1, L2, PASSES, SCALE = 0.3, 1.0, 0.05, 0.01, 2, 10.0
GAP = 32
NAMED = 0x3000
UNKNOWN = "und"
#: Score under which a filter rejects a text.
LEAST_SCORE = 0.3


def _letter(c: int) -> int:
    x = chr(c)
    return ord(x.lower()[0]) if unicodedata.category(x)[0] in "LM" else GAP


FOLD = np.array([_letter(c) for c in range(NAMED)], np.uint32)


def letters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block's texts with every non-letter as a gap, one gap before and after each text."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead]
    point = first.astype(np.uint32)
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        k = np.flatnonzero((first >= low) & (first < high))
        if len(k):
            value = point[k] & mask
            for i in range(1, more + 1):
                value = (value << 6) | (data[lead[k] + i] & 0x3F)
            point[k] = value
    far = np.flatnonzero(point >= NAMED)
    near = FOLD[np.minimum(point, NAMED - 1)]
    if len(far):
        found, of = np.unique(point[far], return_inverse=True)
        near[far] = np.array([_letter(int(c)) for c in found], np.uint32)[of]
    bounds = np.searchsorted(lead, at)
    n = np.diff(bounds)
    out = np.full(len(near) + 2 * len(n), GAP, np.uint32)
    begin = bounds[:-1] + 2 * np.arange(len(n))
    out[spread(begin + 1, n)] = near
    return out, np.append(begin, len(out))


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each place (the last ones reach over the end and are not used)."""
    key = np.zeros(len(points), U)
    for i in range(order):
        key[:len(points) - i] = (key[:len(points) - i] << U(21)) ^ points[i:].astype(U)
    return ((key + U(order)) * U(0x9E3779B97F4A7C15)) >> U(64 - BITS)


def _docs(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    return df.filter(~held_out(id_col) & F.col(label_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"), F.xxhash64(F.col(id_col)).alias("salt"))


def _counts(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, times) of a block, ascending."""
    rows, keys = np.arange(len(at) - 1), []
    for k in ORDERS:
        n = np.maximum(0, np.diff(at) - k + 1)
        keys.append((np.repeat(rows, n).astype(U) << U(BITS)) | grams(points, k)[spread(at[:-1], n)])
    found, times = np.unique(np.concatenate(keys), return_counts=True)
    return (found >> U(BITS)).astype(np.int64), (found & U((1 << BITS) - 1)).astype(np.int64), times


def document_frequency(teach: DataFrame) -> np.ndarray:
    """For each bucket the number of rows that have it, over all rows that may teach; its size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            data, at = text_bytes(b.column(0))
            for lo, hi in blocks(at, 1 << 20):
                _, bucket, _ = _counts(*letters(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]))
                total += np.bincount(bucket, minlength=1 << BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = teach.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, size: int) -> np.ndarray:
    """Weights (size + 1 bias, classes) after PASSES over (buckets, values, class)."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(PASSES):
        for bucket, value, label in rows:
            i = np.append(bucket, size)
            x = np.append(value, 1.0)[:, None]
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            score = (x * w).sum(0)
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            g = x * p
            squared = g * g
            z[i] = zi + g - (np.sqrt(ni + squared) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + squared
    return weights(z, n)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that makes the kept-aside labels likeliest."""
    if not len(labels):
        return 1.0
    best, at = np.inf, 1.0
    for t in np.exp(np.linspace(np.log(0.05), np.log(20), 121)):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        loss = (np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels]).mean()
        if loss < best - 1e-12:
            best, at = loss, float(t)
    return at


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model: classes, weights already times the inverse document frequency, bias and temperature."""
    teach = _docs(df, id_col, text_col, label_col)
    df_counts = document_frequency(teach)
    total = max(1, teach.count())
    idf = np.log((1 + total) / (1 + df_counts)) + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(0))
            for lo, hi in blocks(at, 1 << 20):
                points, bounds = letters(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                row, bucket, times = _counts(points, bounds)
                n = np.bincount(row, minlength=hi - lo)
                cut = np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), lists(bucket, cut), lists(times, cut)], ["label", "salt", "bucket", "times"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(x["salt"], x["label"], np.array(x["bucket"]), np.array(x["times"], float)) for b in batches for x in b.to_pylist()]
        rows.sort(key=lambda r: (r[0], r[1]))  # by hash: the same order wherever the rows came from
        classes = sorted({r[1] for r in rows})
        ready = [(bucket, SCALE * idf[bucket] * times / times.sum(), classes.index(label)) for _, label, bucket, times in rows]
        aside = ready[::5]
        w = follow_the_leader([r for i, r in enumerate(ready) if i % 5], max(1, len(classes)), 1 << BITS)
        scores = np.array([(v[:, None] * w[b]).sum(0) + w[-1] for b, v, _ in aside]).reshape(len(aside), w.shape[1])
        t = temperature(scores, np.array([r[2] for r in aside], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([classes], pa.list_(pa.string())), pa.array([w.tobytes()], pa.binary()), pa.array([t])], ["classes", "w", "t"])

    sample = sampled(teach, "label", F.col("salt"), sample_rows)
    got = sample.mapInArrow(features, "label string, salt long, bucket array<long>, times array<long>").repartition(1).mapInArrow(
        fit, "classes array<string>, w binary, t double").collect()
    classes, w, t = got[0] if got else ([], b"", 1.0)
    w = np.frombuffer(bytes(w)).reshape(-1, max(1, len(classes))) if w else np.zeros(((1 << BITS) + 1, 1))
    return {"classes": list(classes), "weights": np.ascontiguousarray((w[:-1] * idf[:, None] * SCALE).T), "bias": w[-1], "temperature": t}


def told(data: np.ndarray, at: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """Language (an object array of strings) and score of each text of a block."""
    points, bounds = letters(data, at)
    rows, names = len(at) - 1, np.array([*m["classes"], UNKNOWN], object)
    if not m["classes"]:
        return names[np.zeros(rows, int)], np.zeros(rows)
    some = np.concatenate(([0], np.cumsum(points != GAP)))
    known = some[bounds[1:]] > some[bounds[:-1]]
    total, number = np.zeros((len(m["classes"]), rows)), np.zeros(rows)
    for k in ORDERS:
        bucket = grams(points, k).astype(np.int64)
        ends = np.maximum(bounds[:-1], bounds[1:] - k + 1)
        number += ends - bounds[:-1]
        for c in range(len(total)):
            sums = np.concatenate(([0.0], np.cumsum(m["weights"][c][bucket])))
            total[c] += sums[ends] - sums[bounds[:-1]]
    s = (total / np.maximum(1, number) + m["bias"][:, None]) / m["temperature"]
    p = np.exp(s - s.max(0))
    p /= p.sum(0)
    return names[np.where(known, p.argmax(0), len(names) - 1)], np.where(known, np.clip(p.max(0), 0, 1), 0.0)


def predict(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of each row; only the text is looked at."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(1))
            for lo, hi in blocks(at, 1 << 20):
                names, score = told(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], held.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(df: DataFrame, model: dict, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``df``, unchanged, whose text has a language with a score of at least ``least``; nothing shuffles."""
    held = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(place).cast(pa.string()))
            for lo, hi in blocks(at, 1 << 20):
                names, score = told(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], held.value)
                yield b.slice(lo, hi - lo).filter(pa.array((names != UNKNOWN) & (score >= least)))

    return df.mapInArrow(run, df.schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **params) -> DataFrame:
    """id, held_out, lang_pred, score of each row, by a model trained on the rows that may teach."""
    found = predict(df, train(df, id_col, text_col, label_col, **params), id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
