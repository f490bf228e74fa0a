"""Toxicity, cross-tokenizer alignment and periodic runs against brute force and held-out accuracy, with hard cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marketspark.llm import crosstoken, periods, queries, strings, tables, toxicity
from marketspark.llm.extension import COVERS, Extension, shifts
from marketspark.llm.textblocks import text_bytes, words

from .cases import copy_rows, edge_rows, frame, rows_of

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def same(found, columns, want):
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == sorted(want, key=str)


def clashing(df):
    """The frame with more columns, named as the operators name theirs."""
    names = "id text key label salt toxic pairs times runs top kept_text score bias weights groups h n __id __label __sha".split()
    for k, name in enumerate(names):
        if name not in df.columns:
            df = df.selectExpr("*", f"{k} AS `{name}`")
    return df


# ---- identity of words


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_keys_tell_mirrored_strings_apart():
    t = thue_morse(1024)
    texts = [t, t.translate(str.maketrans("ab", "ba")), "x", "", "y" * 3000, "y" * 3001, t]
    data, at = text_bytes(pa.array(texts))
    keys = list(zip(*(x.tolist() for x in strings.span_keys(data, at[:-1], at[1:]))))
    assert keys[0] == keys[6] and len(set(keys)) == 6
    assert len({k[0] for k in keys}) == 6 and len({k[1] for k in keys}) == 6
    codes = strings.word_codes(data, at[:-1], at[1:])
    assert [int(c) for c in codes] == [0, 1, 2, 3, 4, 5, 0]


# ---- periodic runs


def brute_runs(w, least=24, times=3):
    code = {x: k for k, x in enumerate(dict.fromkeys(w))}
    w, out = np.array([code[x] for x in w], np.int64), {}
    for q in range(1, len(w) // times + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (w[q:] == w[:-q]).astype(np.int8), [0]))))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_collapse(w, least=24, times=3):
    runs = brute_runs(w, least, times)
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return runs, top, " ".join(x for i, x in enumerate(w) if i not in gone)


def run_rows():
    rng = np.random.default_rng(3)
    texts = []
    for i in range(80):
        k = int(rng.integers(1, 5))
        w = [f"w{x}" for x in rng.integers(0, k, int(rng.integers(0, 90)))]
        if w and i % 2:
            a, p = int(rng.integers(0, len(w))), int(rng.integers(1, 12))
            w = w[:a] + (w[a:a + p] * 60)[:int(rng.integers(1, 100))] + [f"v{x}" for x in rng.integers(0, k, int(rng.integers(0, 40)))]
        texts.append("  ".join(w) if i % 5 == 0 else "\n".join(w))
    return rows_of(texts + ["a " * 5000, "a b " * 12, "x " * 23, "x " * 24, "é ü " * 40])


@pytest.mark.parametrize("make", [edge_rows, copy_rows, run_rows, list])
def test_periodic_runs(spark, make):
    rows = make()
    df = clashing(tables.ship(spark) and frame(spark, rows).repartition(3))
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        runs, top, kept = brute_collapse(w)
        want.append((i, len(w), runs, top, kept))
    found = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], tuple(r["top"]) if r["top"] else None, r["kept_text"]) for r in periods.collapse(df).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("least,times", [(3, 3), (40, 3), (10, 4)])
def test_run_limits(least, times):
    rng = np.random.default_rng(9)
    docs = [np.concatenate((rng.integers(0, 2, 30), np.tile(rng.integers(0, 3, int(rng.integers(1, 9))), 8), rng.integers(0, 2, 30))) for _ in range(40)]
    row, start, length, period = periods.runs_of(np.concatenate(docs), np.array([len(d) for d in docs]), least, times)
    for k, d in enumerate(docs):
        own = row == k
        assert sorted(zip(start[own].tolist(), length[own].tolist(), period[own].tolist())) == brute_runs(d.tolist(), least, times)


@pytest.mark.parametrize("v", sorted(COVERS))
def test_extensions(v):
    rng = np.random.default_rng(v)
    s = np.concatenate((rng.integers(0, 2, 150), np.tile(rng.integers(0, 2, 7), 30), rng.integers(0, 2, 150)))
    assert (shifts(v, COVERS[v]) >= 0).all()
    i, j = rng.integers(0, len(s), 2000), rng.integers(0, len(s), 2000)
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i.tolist(), j.tolist(), Extension(s, v).common(i, j).tolist()):
        k = 0
        while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        assert n == k


def test_grid_in_parts(monkeypatch):
    monkeypatch.setattr(periods, "AT_ONCE", 50)
    w = np.concatenate((np.arange(300), np.tile(np.arange(5), 40), np.arange(300)))
    found = periods.runs_of(w, np.array([len(w)]))
    assert [tuple(int(x[k]) for x in found[1:]) for k in range(len(found[0]))] == brute_runs(w.tolist())


def test_periodic_query(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w, h = WORD.findall(r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs, top, kept = brute_collapse(w)
        want.append((r["doc_id"], len(runs), *(top or (None,) * 3), None if top is None else 1000 * top[1] // top[2],
                     sha("".join("%d,%d,%d\n" % x for x in runs).encode()), sha(kept.encode())))
    assert sum(x[1] for x in want) > 5
    same(queries.QUERIES["op13_periodic_runs"](spark, SF), ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"), want)


def test_planted_hard_cases(spark):
    rows = [(i, t) for i in range(40) for t in (None, "", " \t ", "one", "a b c d e f g h i j k l")]
    df = spark.createDataFrame(rows + [(None, "a b")], "doc_id long, text string")
    for r in df.select("doc_id", "text", periods.planted(df["doc_id"], df["text"]).alias("p")).collect():
        w, h = WORD.findall(r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is None or h % 10 or not w:
            assert r["p"] == r["text"]
            continue
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        assert r["p"] == " ".join(x if i < a else w[a + (i - a) % p] for i, x in enumerate(w))


# ---- alignment


@pytest.fixture(scope="module")
def plain_sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    sign = crosstoken.byte_of_sign()
    of_a = {i: bytes(sign[c] for c in p) for p, i in a.get_vocab().items() if all(c in sign for c in p)}
    of_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]

    def groups(text):
        """Groups as (ids of A, ids of B), or None."""
        if not text:
            return None
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if not b"".join(of_a[i] for i in x) == b"".join(of_b[i] for i in y) == (" " + text).encode():
            return None
        out, i, j, left, right = [], 0, 0, [], []
        ends = lambda ids, of: set(np.cumsum([len(of[k]) for k in ids]).tolist())
        cuts, at_a, at_b = sorted(ends(x, of_a) & ends(y, of_b)), 0, 0
        for c in cuts:
            left, right = [], []
            while at_a < c:
                at_a += len(of_a[x[i]])
                left.append(x[i])
                i += 1
            while at_b < c:
                at_b += len(of_b[y[j]])
                right.append(y[j])
                j += 1
            out.append((left, right))
        return out

    return groups


ODD = ["<|endoftext|> <s> </s> <0x41>", "a\x1c\x1d b", "x\u0085  y", "z 　", "᠎ q ﻿", "a" * 3000, "\n \n\t x\r\n", " " * 300 + "x", "don't 'S we'll", "▁ x", "\x00a\x00", "١٢٣ ²",
       "日本語のテキスト", "é \U0001F600\U0001F3FD", " ", " lead", "tail "]


@pytest.mark.parametrize("make", [edge_rows, copy_rows, lambda: rows_of(ODD * 2), list])
def test_alignment(spark, plain_sides, make):
    rows = make()
    df = clashing(tables.ship(spark) and frame(spark, rows).repartition(3))
    found = {t: plain_sides(t) for _, t, *_ in rows}
    count = Counter((x[-1], y[-1]) for _, t, *_ in rows for x, y in found[t] or [])
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    want = []
    for i, t, *_ in rows:
        g = found[t] or []
        n = [count[x[-1], y[-1]] for x, y in g]
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        want.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(g), sum(c == best[y[-1]] for c, (_, y) in zip(n, g)), sum(n), sha(told.encode()) if g else ""))
    same(crosstoken.align(df, A, B), ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), want)


def test_groups_of_random_ends():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = rng.integers(1, 80, 4)
        sets = [[np.unique(np.append(rng.integers(1, k + 1, int(rng.integers(1, k + 1))), k)) for k in n] for _ in range(2)]
        base = np.cumsum(n) - n
        a, b = (np.concatenate([s + x for s, x in zip(side, base)]) for side in sets)
        at = [np.cumsum([0] + [len(s) for s in side]) for side in sets]
        first_a, first_b = crosstoken.shared_groups(a, b, *at)
        cuts = np.intersect1d(a, b)
        assert first_a.tolist() == [0, *(np.searchsorted(a, cuts) + 1)[:-1].tolist()] and first_b.tolist() == [0, *(np.searchsorted(b, cuts) + 1)[:-1].tolist()]


def test_alignment_query(spark, plain_sides):
    found = {r["doc_id"]: r for r in queries.QUERIES["op12_crosstoken_alignment"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for r in docs:
        g = plain_sides(r["text"]) or []
        assert found[r["doc_id"]]["n_groups"] == len(g)
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        assert found[r["doc_id"]]["groups_sha256"] == (sha(told.encode()) if g else "")


def test_byte_level_without_ranks(monkeypatch):
    fast = crosstoken.ByteLevel(A)
    assert fast.ranked
    slow = crosstoken.ByteLevel(A)
    slow.ranked, slow.slow = False, Tokenizer.from_file(A)
    slow.slow.encode_special_tokens = True
    assert [x.tolist() for x in slow.encode(ODD)] == [x.tolist() for x in fast.encode(ODD)]


# ---- toxicity


def test_counterfactual_pairs():
    identity = {"k": ["red", "blue", "green"], "o": ["north", "south"]}
    pairs = toxicity.counterfactuals(["The red and North. Nothing here! A blue one", "no term at all", "", "..."], identity)
    assert [r for r, *_ in pairs] == [0] * 4 + [1] * 2
    for r, a, b in pairs:
        if r == 0:
            x, y = a.split(), b.split()
            assert len(x) == len(y) and x != y
            for u, v in zip(x, y):
                assert u == v or any(u in t and v in t for t in identity.values())
        else:
            assert b.split(" ", 1)[1] == a and b.split()[0] in identity["k"] + identity["o"]
    assert pairs == toxicity.counterfactuals(["The red and North. Nothing here! A blue one", "no term at all", "", "..."], identity)


def test_fit_is_a_minimum():
    """The accelerated steps reach the objective of a plain, much longer descent."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(80)]
    y = np.array([1.0 if 3 in r or (5 in r and 7 in r) else -1.0 for r in rows])
    pairs = [np.array([3, -1 - 4]), np.array([9, -1 - 10])]
    x = toxicity.Rows(rows, [np.ones(6)] * 80, 30)
    s = toxicity.Rows([np.where(p < 0, -1 - p, p) for p in pairs], [np.where(p < 0, -1.0, 1.0) for p in pairs], 30)
    weight = np.full(80, 1 / 80)

    def value(w, b):
        return (weight * np.log1p(np.exp(-y * (x.times(w) + b)))).sum() + 1e-3 * np.abs(w).sum() + 5e-4 * w @ w + 2 * (s.times(w) ** 2).mean()

    w, b = toxicity.minimise(x, y, weight, s, 2.0, 400, 1e-3, 1e-3)
    v, c = np.zeros(30), 0.0
    for _ in range(30000):
        r = -y * weight / (1 + np.exp(y * (x.times(v) + c)))
        u = v - 0.1 * (x.back(r) + 1e-3 * v + s.back(s.times(v)) * 2)
        v, c = np.sign(u) * np.maximum(np.abs(u) - 1e-4, 0), c - 0.1 * r.sum()
    assert abs(value(w, b) - value(v, c)) < 1e-5


def biased(spark, n=600):
    """Toxic texts name one group far more often than clean ones; a marker word makes them toxic."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        w = [f"word{x}" for x in rng.integers(0, 200, 30)]
        toxic = i % 3 == 0
        if toxic and rng.random() < 0.8:
            w.insert(int(rng.integers(0, 30)), "nastyword")
        if rng.random() < (0.8 if toxic else 0.05):
            w.insert(int(rng.integers(0, 30)), "muslims")
        rows.append((i, " ".join(w), None))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_fairness_reduces_false_positives(spark):
    tables.ship(spark)
    docs, labels = biased(spark)
    neutral = spark.createDataFrame([(k, f"muslims word{k} word{k + 1} word{k + 2}") for k in range(50)], "doc_id long, text string")
    bare = spark.createDataFrame([(k, f"christians word{k} word{k + 1} word{k + 2}") for k in range(50)], "doc_id long, text string")
    toxic = spark.createDataFrame([(k, f"nastyword word{k} word{k + 1}") for k in range(50)], "doc_id long, text string")
    mean = lambda df, m: np.mean([r["score"] for r in toxicity.score(df, m).collect()])
    plain, fair = (toxicity.train(docs, labels, fairness=x) for x in (0.0, 50.0))
    gap = lambda m: mean(neutral, m) - mean(bare, m)
    assert gap(plain) > 0.2 and gap(fair) < gap(plain) / 4
    assert mean(toxic, fair) > 0.7 and mean(neutral, fair) < 0.5


def test_toxicity_hard_cases(spark):
    tables.ship(spark)
    rows = edge_rows()
    df = clashing(frame(spark, rows))
    labels = spark.createDataFrame([(0, 1, 9), (1, 0, 9), (3, None, 9), (5, 1, 9), (5, 0, 9), (6, 0, 9), (8, 0, 9), (None, 1, 9)], "doc_id long, toxic int, text int")
    for told in (labels, labels.filter("toxic = 1"), labels.limit(0)):
        found = toxicity.rate(df, told).collect()
        assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
        assert all(r["predicted"] == int(r["score"] >= 0.5) for r in found)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
        score = {r["doc_id"]: r["score"] for r in found}
        assert score[5] == score[6] and score[0] == score[1] == score[2]
    assert toxicity.rate(df.limit(0), labels).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in queries.QUERIES["op11_counterfactual_toxicity"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    mine = [(found[r["doc_id"]]["predicted"], r["toxic"]) for r in labels if found[r["doc_id"]]["held_out"]]
    assert np.mean([p == t for p, t in mine]) > 0.9
    assert sum(p for p, t in mine if not t) <= 0.02 * len(mine)
    again = {r["doc_id"]: r["score"] for r in queries.QUERIES["op11_counterfactual_toxicity"](spark, sf).collect()}
    assert all(abs(again[k] - v["score"]) < 1e-9 for k, v in found.items())
    docs = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(50).collect()]
    data, at = text_bytes(toxicity.plain(pa.array(docs, pa.string())))
    row, f = toxicity.features(data, at)
    start, *_ = words(data, at)
    assert len(start) and (np.diff(row) >= 0).all() and f.max() < toxicity.SIZE


# ---- equality in the earlier operators does not rest on polynomials of bytes


def mirrored_rows():
    t = thue_morse(1024)
    m = t.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{k}" for k in range(12))
    short = thue_morse(128)
    texts = [t, m, f"{t} {tail}", f"{m} {tail}", short + "x" * 60, short.translate(str.maketrans("ab", "ba")) + "x" * 60, f"{t} {tail}"]
    return rows_of(texts)


def test_mirrored_strings_are_different(spark):
    from marketspark.llm import ngram_join, substrings, suffixes
    from marketspark.llm.tokens import Encoder

    from .test_operators import TOKENIZER, brute_bytes

    rows = mirrored_rows()
    df = tables.ship(spark) and frame(spark, rows).repartition(1)
    removed = {r["doc_id"]: r["n_removed"] for r in substrings.strip(df).collect()}
    assert removed == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 13}
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in suffixes.strip(df).collect()), key=str)
    assert found == brute_bytes([r[:2] for r in rows])
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similar(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 2}
    plain = Tokenizer.from_file(TOKENIZER)
    data, at = text_bytes(pa.array([r[1] for r in rows]))
    ids, begin, *_ = Encoder(TOKENIZER).encode(data, at)
    for k, r in enumerate(rows):
        assert ids[begin[k]:begin[k + 1]].tolist() == plain.encode(r[1], add_special_tokens=False).ids


def test_pieces_that_share_one_key(monkeypatch):
    from marketspark.llm import tokens

    from .test_operators import TOKENIZER

    real = tokens.span_keys
    monkeypatch.setattr(tokens, "span_keys", lambda *a: (real(*a)[0] & np.uint64(3), real(*a)[1]))
    texts = ["the quick brown fox jumps over the lazy dog", "lorem ipsum dolor", "", "the fox"]
    plain, own = Tokenizer.from_file(TOKENIZER), tokens.Encoder(TOKENIZER)
    for _ in range(2):
        data, at = text_bytes(pa.array(texts))
        ids, begin, *_ = own.encode(data, at)
        assert [ids[begin[k]:begin[k + 1]].tolist() for k in range(4)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
