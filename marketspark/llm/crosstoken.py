"""Alignment of the tokens of two tokenizers: groups of tokens that cover the same bytes, and which tokens end together.

Each text is encoded by both tokenizers; byte offsets where tokens of both end (shared cuts) divide it. The cuts are found
by divide and conquer: a shared end near the middle of an interval is located by bisecting the two lists of ends in turn
outward from the middle, both halves go on in the same way, and an interval without a shared end inside is a leaf, one
group. All intervals of a block of texts take a level together.

A first pass writes, for every document, its groups and its linked id pairs with their numbers. Pair counts of the corpus
come from partial sums and one shuffle. Their table is small whatever the corpus is: tokens that end together cover bytes
of which one is an ending of the other, so there are no more pairs than endings of vocabulary entries (times entries
with the same bytes); so it may be broadcast to the second pass, which reads the written table only.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens and
all zeros; strings of special tokens are plain text; repeated rows count as often as they come; documents of any length
are encoded whole; an empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .tables import stored
from .textblocks import U, blocks, spread, text_bytes

#: The pattern that a byte-level file without one of its own splits texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text in a block.
BLOCK = 1 << 20


def byte_of_sign() -> dict[str, int]:
    """Byte that each sign of a byte-level vocabulary stands for: printable bytes for themselves, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Side:
    """One tokenizer: ids of texts, and the bytes of every id."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.digits = max(1, len(str(max(0, len(pieces) - 1))))
        signs = np.zeros((len(pieces), self.digits), np.uint8)  # decimal signs of each id, zeros before them
        ids = np.arange(len(pieces))
        for k in range(self.digits):
            power = 10 ** (self.digits - 1 - k)
            signs[:, k] = np.where((ids >= power) | (power == 1), 48 + ids // power % 10, 0)
        self.signs = signs

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raise NotImplementedError


class ByteLevel(Side):
    """A byte-level file: by its ranks where its merges come in the order of their ids, else by its own library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs, vocab = byte_of_sign(), spec["model"]["vocab"]
        pieces = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens") or [])]))
        for piece, i in vocab.items():
            pieces[i] = bytes(signs[c] for c in piece)
        super().__init__(pieces)
        joined = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        self.ranked = plain and joined == sorted(joined) and len(set(joined)) == len(joined) and len(vocab) == 256 + len(joined) and not spec["model"].get("ignore_merges")
        if self.ranked:
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={pieces[i]: i for i in vocab.values()}, special_tokens={})
        else:
            self.slow = Tokenizer.from_file(path)
            self.slow.encode_special_tokens = True

    def encode(self, texts):
        if self.ranked:
            return [np.array(self.fast.encode_ordinary(t), np.int64) for t in texts]
        return [np.array(e.ids, np.int64) for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(Side):
    """A sentence-piece file. It puts the space before the text itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        unseen = lambda i: self.model.is_control(i) or self.model.is_unknown(i)
        super().__init__([b"" if unseen(i) else bytes([int(self.model.id_to_piece(i)[1:-1], 16)]) if self.model.is_byte(i)
                          else self.model.id_to_piece(i).replace("▁", " ").encode() for i in ids])

    def encode(self, texts):
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    return ByteLevel(path_a), Pieces(path_b)


def _faithful(side: Side, ids: np.ndarray, rows: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows whose tokens' joined bytes are the row's bytes."""
    n = len(at) - 1
    size = np.bincount(rows, weights=side.size[ids], minlength=n).astype(np.int64)
    good = size == np.diff(at)
    own = good[rows]
    joined = side.bytes[spread(side.begin[ids[own]], side.size[ids[own]])]
    mine = np.flatnonzero(good)
    differs = joined != data[spread(at[mine], size[mine])]
    good[np.searchsorted(at, spread(at[mine], size[mine])[differs], "right") - 1] = False
    return good


def shared_groups(end_a: np.ndarray, end_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token of each group on both sides, in order.

    ``end_a`` and ``end_b`` are the strictly ascending ends of the tokens of texts laid side by side; text r has the tokens
    at_a[r] to at_a[r + 1] - 1 and at_b[r] to at_b[r + 1] - 1, at least one each, and both end with the text.
    """
    a0, a1, b0, b1 = at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]
    leaves = []
    while len(a0):
        done = (a1 - a0 == 1) | (b1 - b0 == 1)
        leaves.append((a0[done], b0[done]))
        a0, a1, b0, b1 = (x[~done] for x in (a0, a1, b0, b1))
        if not len(a0):
            break
        middle = (a0 + a1 - 2) >> 1
        cut_a, cut_b = np.full(len(a0), -1), np.full(len(a0), -1)
        dry = np.zeros(len(a0), bool)  # nothing is shared from the cut to the interval's end
        live, i = np.arange(len(a0)), middle.copy()
        while len(live):  # to the right: the next end of b, then the next of a, until they meet or the interval ends
            j = np.searchsorted(end_b, end_a[i])
            inside = (i < a1[live] - 1) & (j < b1[live] - 1)
            dry[live[~inside]] = True
            live, i, j = live[inside], i[inside], j[inside]
            met = end_b[j] == end_a[i]
            cut_a[live[met]], cut_b[live[met]] = i[met], j[met]
            live, j = live[~met], j[~met]
            i = np.searchsorted(end_a, end_b[j])
        live = np.flatnonzero(dry)
        i = middle[live] - 1
        while len(live):  # to the left in the same way
            inside = i >= a0[live]
            live, i = live[inside], i[inside]
            j = np.searchsorted(end_b, end_a[i], "right") - 1
            inside = j >= b0[live]
            live, i, j = live[inside], i[inside], j[inside]
            met = end_b[j] == end_a[i]
            cut_a[live[met]], cut_b[live[met]] = i[met], j[met]
            live, j = live[~met], j[~met]
            i = np.searchsorted(end_a, end_b[j], "right") - 1
        none = cut_a < 0
        leaves.append((a0[none], b0[none]))
        leaves.append((cut_a[~none & dry] + 1, cut_b[~none & dry] + 1))
        left, right = ~none, ~none & ~dry
        a0, a1, b0, b1 = (np.concatenate(x) for x in (
            (a0[left], cut_a[right] + 1), (cut_a[left] + 1, a1[right]), (b0[left], cut_b[right] + 1), (cut_b[left] + 1, b1[right])))
    first_a, first_b = (np.concatenate(x) for x in zip(*leaves)) if leaves else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(first_a, kind="stable")
    return first_a[order], first_b[order]


def written(a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, group_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3` of each row as one array of bytes and where each row begins; rows hold the groups group_at[r] to group_at[r + 1] - 1."""
    width, groups = max(a.digits, b.digits) + 1, len(first_a)
    end_a, end_b = np.append(first_a[1:], len(ids_a)), np.append(first_b[1:], len(ids_b))
    slots = np.zeros((len(ids_a) + len(ids_b), width), np.uint8)
    slots[:, -1] = 44
    of_a, of_b = np.repeat(np.arange(groups), end_a - first_a), np.repeat(np.arange(groups), end_b - first_b)
    slots[np.arange(len(ids_a)) + first_b[of_a], width - 1 - a.digits:-1] = a.signs[ids_a]
    slots[np.arange(len(ids_b)) + end_a[of_b], width - 1 - b.digits:-1] = b.signs[ids_b]
    slots[end_a + first_b - 1, -1] = 124
    slots[end_a + end_b - 1, -1] = 59
    full = np.flatnonzero(np.diff(group_at))
    slots[end_a[group_at[full + 1] - 1] + end_b[group_at[full + 1] - 1] - 1, -1] = 0  # a row's last sign
    signs = np.concatenate((np.zeros(1, np.int64), np.cumsum((slots != 0).sum(1))))
    flat = slots.ravel()
    last = np.append(0, (end_a + end_b))[group_at]
    return flat[flat != 0], signs[last]


def pack_numbers(values: np.ndarray) -> bytes:
    """Ascending or small whole numbers below 2^64 by byte planes, which compress well beside each other."""
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_numbers(held: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def groups(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256 (and groups, with ``with_text``), pairs and times of each row.

    ``pairs``: the row's different linked id pairs (id of A times the size of B's vocabulary plus id of B), ascending, as
    packed differences; ``times``: how often each is linked. ``paths`` name the byte-level and the sentence-piece file.
    """
    text_kind = ", groups string" if with_text else ""
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["groups"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(path_a, path_b)
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            _, at_all = text_bytes(column)
            for lo, hi in blocks(at_all, BLOCK):
                part = column.slice(lo, hi - lo)
                rows, full = hi - lo, np.flatnonzero(np.diff(at_all[lo:hi + 1]))
                part = part.take(pa.array(full))
                plain = part.to_pylist()
                data, at = text_bytes(pc.binary_join_element_wise(" ", part, ""))
                ids, of, keep = [], [], np.ones(len(full), bool)
                for side, texts in ((a, [" " + t for t in plain]), (b, plain)):
                    found = side.encode(texts) if texts else []
                    ids.append(np.concatenate([np.zeros(0, np.int64), *found]))
                    of.append(np.repeat(np.arange(len(full)), [len(x) for x in found]) if found else np.zeros(0, np.int64))
                    some = side.size[ids[-1]] > 0  # ids without bytes cover nothing
                    if not some.all():
                        keep[of[-1][~some]] = False
                    keep &= _faithful(side, ids[-1], of[-1], data, at)
                base = np.cumsum(np.diff(at) * keep) - np.diff(at) * keep
                count, end, first_of = [], [], []
                for k, side in enumerate((a, b)):
                    mine = keep[of[k]]
                    ids[k], of[k] = ids[k][mine], of[k][mine]
                    count.append(np.bincount(of[k], minlength=len(full)))
                    end.append(np.cumsum(side.size[ids[k]]))
                    first_of.append(np.concatenate((np.zeros(1, np.int64), np.cumsum(count[k][keep]))))
                first_a, first_b = shared_groups(end[0], end[1], first_of[0], first_of[1])
                row = of[0][first_a]
                group_at = np.searchsorted(row, np.arange(len(full) + 1))
                flat, begin = written(a, b, ids[0], ids[1], first_a, first_b, group_at)
                raw = flat.tobytes()
                told = [raw[x:z] for x, z in zip(begin[:-1].tolist(), begin[1:].tolist())]
                # tokens of a group that end together: its last ones
                last_a, last_b = np.append(first_a[1:], len(ids[0])) - 1, np.append(first_b[1:], len(ids[1])) - 1
                code = ids[0][last_a] * len(b.size) + ids[1][last_b]
                order = np.lexsort((code, row))
                code, row = code[order], row[order]
                head = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))) if len(code) else np.zeros(0, np.int64)
                times = np.diff(np.append(head, len(code)))
                cut = np.searchsorted(row[head], np.arange(len(full) + 1))
                code = code[head]
                n_groups = np.diff(group_at)
                numbers = np.zeros((4, rows), np.int64)
                numbers[:, full] = count[0] * keep, count[1] * keep, n_groups, n_groups
                texts, pairs, often = [b""] * rows, [b""] * rows, [b""] * rows
                for k in np.flatnonzero(keep).tolist():
                    x, z = cut[k], cut[k + 1]
                    texts[full[k]], pairs[full[k]], often[full[k]] = told[k], pack_numbers(np.diff(code[x:z], prepend=0)), pack_numbers(times[x:z])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, rows), *(pa.array(x) for x in numbers),
                    pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string()), pa.array(pairs, pa.binary()), pa.array(often, pa.binary()),
                    *([pa.array([t.decode() for t in texts], pa.string())] if with_text else [])], names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary{text_kind}"
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n: links of the whole corpus that hold each linked id pair. Every task sends partial sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, held = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0

        def summed():
            code, where = np.unique(np.concatenate(pairs), return_inverse=True)
            return code, np.bincount(where, weights=np.concatenate(times), minlength=len(code)).astype(np.int64)

        for b in batches:
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p:
                    pairs.append(np.cumsum(unpack_numbers(p)))
                    times.append(unpack_numbers(t).astype(np.int64))
                    held += len(times[-1])
            if held > 1 << 22:
                code, n = summed()
                pairs, times, held = [code], [n], 0
        code, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], ["pair", "n"])

    return found.select("pairs", "times").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    n_best: links whose pair's count is the highest of its B id in the corpus (ties included); count_sum: sum of the
    counts of all links' pairs.
    """
    found = stored(groups(df, path_a, path_b, id_col, text_col), "token-groups", compression="zstd")
    _, b = sides(path_a, path_b)
    width = len(b.size)
    counts = stored(pair_counts(found), "token-pairs")
    best = counts.groupBy(F.pmod("pair", F.lit(width)).alias("b")).agg(F.max("n").alias("most"))
    told = counts.join(best, F.pmod(F.col("pair"), F.lit(width)) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("top"))
    rows = told.toArrow()  # no more rows than endings of vocabulary entries, see above
    code = rows["pair"].to_numpy()
    order = np.argsort(code)
    held = df.sparkSession.sparkContext.broadcast(tuple(x[order] for x in (code, rows["n"].to_numpy(), rows["top"].to_numpy())))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, top = held.value
        for x in batches:
            sums = np.zeros((2, x.num_rows), np.int64)
            for k, (p, t) in enumerate(zip(x.column(6).to_pylist(), x.column(7).to_pylist())):
                if p:
                    at = np.searchsorted(code, np.cumsum(unpack_numbers(p)).astype(np.int64))
                    times = unpack_numbers(t).astype(np.int64)
                    sums[:, k] = (times * top[at]).sum(), (times * n[at]).sum()
            yield pa.RecordBatch.from_arrays([*(x.column(k) for k in range(5)), *(pa.array(v) for v in sums), x.column(5)],
                                             ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return found.select(F.col(f"`{id_col}`").alias("id"), "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times").mapInArrow(
        lambda it: add(b.select([0, 1, 2, 3, 4, 5, 6, 7]) for b in it), schema).withColumnRenamed("id", id_col)
