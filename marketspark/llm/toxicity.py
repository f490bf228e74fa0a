"""Toxicity of a text: a linear classifier that is trained not to react to which group a sentence names.

A text is the set of its words, beginnings of words and pairs of neighbouring words (letters, marks and digits, lower case),
each once, at least twice and at least four times, hashed into a fixed table; an indicator is scaled down with the share of
rows that have it. Labelled sentences are copied with the identity
terms in them swapped for others of the same kind (counterfactuals); a sentence that names no group gets a term put in
front. The fit minimises the logistic loss of the labelled texts plus L1 and L2 penalties plus ``fairness`` times the mean
squared change of the score (log odds) over all such pairs, by accelerated proximal gradient steps. So a term's weight
stays small even where the labelled toxic texts name its group more often, and neutral mentions are not flagged.

The fit looks at a bounded sample of labelled rows (``sample_rows`` of each class, ``SWAPS`` pairs a row) and weighs classes
as in all labelled rows, so scores are probabilities there.

Defined cases: null and empty texts have no words and get the score of the bias; null labels teach nothing; of several
labels of one id the largest counts; rows with equal ids all teach; without labels of both classes every score is the
share of label 1 (0.5 without any); equal texts have equal scores, whatever other columns say; an empty table gives an
empty result; only the id and text columns are read, whatever other columns are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import SAMPLE_ROWS, sampled
from .strings import span_keys
from .textblocks import U, blocks, lists, mix, text_bytes, words

BITS = 19
SIZE = 1 << BITS
#: Bytes of the beginnings of words, and how many counts (1, 2, 4) are told apart.
STEMS, LEVELS = (4, 6, 8), 3
#: Penalties and steps of the fit. Features that fewer sampled rows have are left out.
L1, L2, FAIRNESS, STEPS, ROWS_LEAST = 2e-4, 1e-5, 5.0, 200, 3
#: Counterfactual pairs of one sampled row at most.
SWAPS = 6
THRESHOLD = 0.5
#: Share of rows from which on an indicator is scaled down.
COMMON = 0.05

#: Default identity terms by kind; terms are swapped inside their kind only.
IDENTITY = {
    "gender": "woman women man men girl girls boy boys female male frau frauen mann männer femme femmes homme hommes mujer mujeres hombre hombres".split(),
    "religion": "christian christians muslim muslims jew jews jewish hindu hindus buddhist buddhists atheist atheists christen muslime juden chrétiens musulmans juifs cristianos musulmanes judíos".split(),
    "origin": "african africans american americans asian asians european europeans mexican mexicans arab arabs immigrant immigrants refugee refugees ausländer flüchtlinge étrangers réfugiés inmigrantes refugiados".split(),
    "colour": "black white brown schwarze weiße noirs blancs negros blancos".split(),
    "orientation": "gay lesbian bisexual straight transgender queer lesben schwule lesbiennes lesbianas".split(),
    "ability": "deaf blind disabled autistic gehörlose blinde sourds aveugles sordos ciegos".split(),
}

SENTENCE = re.compile(r"[.!?\n]+")
NO_WORD = r"[^\pL\pM\pN]+"


def held_out(id_col: str) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(5)) == 0, F.lit(False))


def plain(column: pa.Array) -> pa.Array:
    """Words of letters, marks and digits in lower case, between single spaces."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), NO_WORD, " ")


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of a block of plain texts, ascending."""
    start, end, row = words(data, at)
    h, _ = span_keys(data, start, end)
    codes, rows = [h], [row]
    for n in STEMS:
        long = np.flatnonzero(end - start > n)
        k, _ = span_keys(data, start[long], start[long] + n)
        codes.append(mix(k + U(n)))
        rows.append(row[long])
    both = np.flatnonzero(row[1:] == row[:-1])
    codes.append(mix(h[both] * U(0x9E3779B97F4A7C15) + h[np.minimum(both + 1, len(h) - 1)]))
    rows.append(row[both])
    held, times = np.unique((np.concatenate(rows).astype(U) << U(40)) | (np.concatenate(codes) >> U(24)), return_counts=True)
    found = []
    for level in range(LEVELS):
        some = held[times >= 1 << level]
        found.append((some >> U(40) << U(BITS)) | (mix((some << U(2)) + U(level) & U((1 << 42) - 1)) >> U(64 - BITS)))
    found = np.unique(np.concatenate(found))
    return (found >> U(BITS)).astype(np.int64), (found & U(SIZE - 1)).astype(np.int64)


def counterfactuals(texts: list[str], identity: dict[str, list[str]], most: int = SWAPS) -> list[tuple[int, str, str]]:
    """(row, sentence, the same with its identity terms swapped) in plain words, ``most`` a row at most, in the order of the texts.

    Each sentence that names a group pairs with the two next terms of the kind; if no sentence of a text does, the middle
    one gets a term of some kind in front. Which terms come is a function of the text alone.
    """
    kind_of = {term: (kind, k) for kind, terms in identity.items() for k, term in enumerate(terms)}
    every = [*kind_of]
    cut = [SENTENCE.split(t) for t in texts]
    clean = iter(plain(pa.array([x for c in cut for x in c], pa.string())).to_pylist())
    out = []
    for r, c in enumerate(cut):
        sentences, found, turn = [w for w in (next(clean).split() for _ in c) if w], [], len(texts[r])
        for w in sentences:
            hits = [i for i, x in enumerate(w) if x in kind_of]
            if not hits:
                continue
            for step in (1, 2):
                swapped = list(w)
                for i in hits:
                    kind, k = kind_of[w[i]]
                    others = [t for t in identity[kind] if t != w[i]] or [w[i]]
                    swapped[i] = others[(k + step + turn) % len(others)]
                turn += 1
                if swapped != w:
                    found.append((r, " ".join(w), " ".join(swapped)))
            if len(found) >= most:
                break
        if not found and sentences and every:
            s = " ".join(sentences[len(sentences) // 2])
            found = [(r, s, f"{every[(turn + step * 7) % len(every)]} {s}") for step in range(2)]
        out += found[:most]
    return out


def changes(pairs: list[tuple[int, str, str]]) -> list[np.ndarray]:
    """Of each pair the features that only the second has, and, as -1 - feature, those that only the first has."""
    data, at = text_bytes(pa.array([x for p in pairs for x in p[1:]], pa.string()))
    row, f = features(data, at)
    cut = np.searchsorted(row, np.arange(2 * len(pairs) + 1))
    sets = [f[a:b] for a, b in zip(cut[:-1], cut[1:])]
    return [np.concatenate((np.setdiff1d(b, a, True), -1 - np.setdiff1d(a, b, True))) for a, b in zip(sets[::2], sets[1::2])]


class Rows:
    """A sparse matrix by rows of (features, values), with its products."""

    def __init__(self, parts: list[np.ndarray], values: list[np.ndarray], columns: int):
        self.row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        self.column = np.concatenate([np.zeros(0, np.int64), *parts])
        self.value = np.concatenate([np.zeros(0), *values])
        self.shape = (len(parts), columns)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column] * self.value, minlength=self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=r[self.row] * self.value, minlength=self.shape[1])


def minimise(x: Rows, y: np.ndarray, weight: np.ndarray, swaps: Rows, fairness: float, steps: int = STEPS, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """w, bias of least sum(weight log(1 + exp(-y (x w + bias)))) + l1 |w| + l2 |w|^2 / 2 + fairness * mean((swaps w)^2); weights sum to one."""
    pairs = max(1, swaps.shape[0])

    def gradient(w, bias):
        r = -y * weight / (1 + np.exp(np.clip(y * (x.times(w) + bias), -30, 30)))
        g = x.back(r) + l2 * w
        if swaps.shape[0]:
            g += swaps.back(swaps.times(w)) * (2 * fairness / pairs)
        return g, r.sum()

    v, c = np.ones(x.shape[1]), 1.0  # largest curvature by power iteration
    top = 1.0
    for _ in range(20):
        m = weight * (x.times(v) + c)
        u, d = x.back(m) / 4, m.sum() / 4
        if swaps.shape[0]:
            u += swaps.back(swaps.times(v)) * (2 * fairness / pairs)
        top = np.sqrt(u @ u + d * d)
        v, c = u / top, d / top
    step = 1 / (1.1 * top + l2)
    w, bias = np.zeros(x.shape[1]), 0.0
    z, zb, t = w, bias, 1.0
    for _ in range(steps):
        g, gb = gradient(z, zb)
        new = z - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = zb - step * gb
        if ((z - new) @ (new - w)) + (zb - new_bias) * (new_bias - bias) > 0:
            t = 1.0  # the momentum points uphill: start it anew
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    return w, float(bias)


def fit_rows(rows: list[tuple[np.ndarray, int]], pairs: list[np.ndarray], share: tuple[float, float] = (1.0, 1.0), fairness: float = FAIRNESS) -> dict:
    """Weights and bias from (features, label 0/1) rows and the changes of counterfactual pairs; ``share``: sampled part of each class."""
    y = np.array([1.0 if label else -1.0 for _, label in rows])
    weight = np.where(y > 0, 1 / share[1], 1 / share[0])
    if len(set(y.tolist())) < 2:
        mean = float((y > 0).mean()) if len(y) else 0.5
        return {"weights": np.zeros(SIZE), "bias": float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))}
    flat = np.concatenate([f for f, _ in rows])
    have = np.bincount(flat, minlength=SIZE)
    changed = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.where(p < 0, -1 - p, p) for p in pairs)]))
    used = np.flatnonzero(have >= ROWS_LEAST)
    place = np.full(SIZE, -1, np.int64)
    place[used] = np.arange(len(used))
    scale = 1 / np.sqrt(1 + have[used] / (COMMON * len(rows)))

    def sparse(parts: list[np.ndarray]) -> Rows:
        own, value = [], []
        for p in parts:
            f = place[np.where(p < 0, -1 - p, p)]
            own.append(f[f >= 0])
            value.append(np.where(p < 0, -1.0, 1.0)[f >= 0] * scale[own[-1]])
        return Rows(own, value, len(used))

    swaps = sparse(pairs if fairness and len(changed) else [])
    w, bias = minimise(sparse([f for f, _ in rows]), y, weight / weight.sum(), swaps, fairness)
    weights = np.zeros(SIZE)
    weights[used] = w * scale
    return {"weights": weights, "bias": bias}


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS,
          identity: dict[str, list[str]] | None = None, fairness: float = FAIRNESS) -> dict:
    """Fits on at most about ``sample_rows`` labelled ids of each class; the ids are broadcast (that many at most)."""
    identity = IDENTITY if identity is None else identity
    may = labels.filter(~held_out(id_col) & F.col(f"`{label_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{label_col}`").alias("toxic"))
    may = may.groupBy("key").agg(F.when(F.max("toxic") > 0, 1).otherwise(0).cast("long").alias("label"))
    counts = dict(may.groupBy("label").count().collect())  # two rows at most
    some = sampled(may, "label", F.col("key"), sample_rows)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(some), F.col("id") == F.col("key"))
    rows = rows.select("text", "label", F.xxhash64("id", "text").alias("salt"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(plain(b.column(0)))
            for lo, hi in blocks(at, 1 << 20):
                row, f = features(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                pairs = counterfactuals([t or "" for t in b.column(0).slice(lo, hi - lo).to_pylist()], identity)
                at_row = np.searchsorted([r for r, *_ in pairs], np.arange(hi - lo + 1))
                swaps = pa.ListArray.from_arrays(pa.array(at_row, pa.int32()), pa.array([x.tolist() for x in changes(pairs)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), lists(f, cut, pa.int32()), swaps], ["label", "salt", "f", "swaps"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            for i in range(b.num_rows):
                found.append((b.column(1)[i].as_py(), b.column(0)[i].as_py(), np.asarray(b.column(2)[i].values).astype(np.int64),
                              [np.asarray(p, np.int64) for p in b.column(3)[i].as_py()]))
        found.sort(key=lambda r: (r[0], r[1], len(r[2])))
        kept = {label: sum(1 for r in found if r[1] == label) for label in (0, 1)}
        share = tuple(min(1.0, kept[k] / counts[k]) if counts.get(k) and kept[k] else 1.0 for k in (0, 1))
        m = fit_rows([(f, label) for _, label, f, _ in found], [p for *_, pairs in found for p in pairs], share, fairness)
        yield pa.RecordBatch.from_arrays([pa.array([m["weights"].tobytes()], pa.binary()), pa.array([m["bias"]])], ["weights", "bias"])

    got = rows.mapInArrow(make, "label long, salt long, f array<int>, swaps array<array<int>>").repartition(1).mapInArrow(fit, "weights binary, bias double").collect()
    if not got:
        return fit_rows([], [])
    return {"weights": np.frombuffer(bytes(got[0]["weights"])), "bias": got[0]["bias"]}


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row; only the text is looked at."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            data, at = text_bytes(plain(b.column(1)))
            for lo, hi in blocks(at, 1 << 20):
                row, f = features(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                margin = np.bincount(row, weights=m["weights"][f], minlength=hi - lo) + m["bias"]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], ["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def rate(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, **params) -> DataFrame:
    """id, held_out, score, predicted (1 from ``threshold`` on) of each row."""
    told = score(df, train(df, labels, id_col, text_col, label_col, **params), id_col, text_col)
    return told.select(id_col, held_out(id_col).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
