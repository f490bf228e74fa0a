"""Sequences of neighbouring documents, packed along a space-filling curve.

A document's vector is the hashed sum of its pieces of text, projected to four dimensions by the signs in each piece's hash
(a random projection whose matrix is never stored). The Hilbert index of the quantised vector puts similar documents next
to each other; documents are range-sorted by it, and the run of all their ids is cut every 2,048 ids. Only the last sequence
of all is short. Ids are tokenised once and written; the range sort moves three numbers a document, and the ids join their
places afterwards.

Defined cases: a null or empty text is one end id; rows that repeat are packed as often as they occur; null ids are packed;
an empty table gives no sequence. A document may reach over any number of sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hilbert import hilbert_index
from .tables import running_positions, stored
from .textblocks import U, binary, blocks, lists, text_bytes
from .tokens import encoder

LENGTH = 2048
END_ID = 1
#: Dimensions of the projection and bits of each; an edge of the grid lies at this mean sign.
DIMENSIONS, BITS, EDGE = 4, 10, 0.25


def curve_of(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Hilbert index of each row's projected vector."""
    n = np.maximum(1, np.bincount(row, minlength=rows))
    point = np.empty((rows, DIMENSIONS), np.int64)
    for d in range(DIMENSIONS):
        sign = ((hashes >> U(7 + 13 * d)) & U(1)).astype(np.float32) * 2 - 1
        mean = np.bincount(row, weights=sign, minlength=rows) / n
        point[:, d] = np.clip((mean / EDGE + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_index(point, BITS)


def token_table(df: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, curve, ids): ids of each text with the end id, as packed little-endian integers of two or four bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for b in batches:
            data_all, at_all = text_bytes(b.column(2))
            for lo, hi in blocks(at_all):
                ids, at, hashes, row = e.encode(data_all[at_all[lo]:at_all[hi]], at_all[lo:hi + 1] - at_all[lo])
                full = np.insert(ids, at[1:], END_ID)
                ends = at + np.arange(len(at))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(ends)),
                    pa.array(curve_of(hashes, row, hi - lo)), binary(full, ends * full.itemsize)], ["row", "id", "n", "curve", "ids"])

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return stored(rows.mapInArrow(make, "row long, id long, n long, curve long, ids binary"), "token-ids")


def pack(df: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve and, unless told otherwise,
    ``ids``; pieces ordered by sequence_id and offset are the packed sequences."""
    kind = encoder(tokenizer).kind
    table = token_table(df, tokenizer, id_col, text_col)
    placed = running_positions(table.select("curve", "id", "row", "n"), ["curve", "id", "row"], {"at": "n"}).select(F.col("row").alias("r"), "at")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve", "ids"][:9 if with_ids else 8]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, curve, at = (b.column(i).to_numpy() for i in (1, 2, 4))
            data, bounds = text_bytes(b.column(3))
            ids = np.frombuffer(data.tobytes(), kind).astype("<u4")
            base = bounds[:-1] // np.dtype(kind).itemsize
            first, last = at // length, (at + n - 1) // length
            k = last - first + 1
            doc = np.repeat(np.arange(len(n)), k)
            sequence = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k) + first[doc]
            begin = np.maximum(at[doc], sequence * length)
            size = np.minimum(at[doc] + n[doc], (sequence + 1) * length) - begin
            start = begin - at[doc]
            raw, where = memoryview(ids.tobytes()), (base[doc] + start) * 4
            pieces = [raw[w:w + 4 * s] for w, s in zip(where.tolist(), size.tolist())]
            out = [b.column(0).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                   pa.array(n[doc]), pa.array(sequence), pa.array(begin - sequence * length), pa.array(curve[doc])]
            if with_ids:
                out.append(lists(ids.astype(np.int32), np.concatenate(([0], np.cumsum(size))), pa.int32()))  # pieces follow each other
            yield pa.RecordBatch.from_arrays(out, names)

    joined = table.join(placed, F.col("row") == F.col("r")).select("id", "n", "curve", "ids", "at")
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long" + ", ids array<int>" * with_ids
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
