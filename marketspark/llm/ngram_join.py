"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Documents with the same shingle set are one row of the matrix. A row of which too few shingles occur in any other row is
discarded by its size-derived bound before anything is sent (a bounded bitmap tells repeated shingles). A pair can only reach the threshold when it shares one of
the first n - ceil(t n) + 1 shingles of both rows in any common order; rare shingles come first, so the columns of the
product stay short. The smaller set of a pair even shares one of its first n - ceil(2 t n / (1 + t)) + 1 shingles with the other's prefix, so
a column that no row has so early links nothing and is left out, and two rows that both have it later only are not compared. All rows of a column
meet in the block of its hub (the row with the smallest id in the column), so the blocks hold every candidate pair, and a group of copies lies in few blocks. Inside a block, rows and columns that cannot
reach their size-derived bound are discarded first (a row needs ceil(t n) shingles that others in the block have too); then
row after row is multiplied with the block, overlap counts add up, and rows that are already connected are not compared
again. So neither pairs of a group are written out nor is a link between different texts lost for the components.

Blocks are bounded in rows and shingles. A hub with more rows is cut into blocks that all carry the hub; the rows outside
the largest component of their hub are then compared with all its rows in tiles, each of two groups of half a block.

Defined cases: null and empty texts have an empty set and link with nothing; a text with fewer words than a shingle is one
shingle; rows with the same id are one document for the components, each with its own number of shingles; rows with a null id
take no part and get a null component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .minimisers import repeated_seeds
from .tables import bits_for, bitmap_of, checkpointed, in_bitmap, stored
from .strings import span_keys
from .textblocks import LOWER, STEP, U, binary, blocks, lists, mix, spread, text_bytes, windows, words

WORDS = 5
#: Threshold as a ratio of integers.
JACCARD = (75, 100)
#: Rows and shingles of one block of the product.
BLOCK_ROWS = 4096
BLOCK_SHINGLES = 4_000_000
#: Counters that decide which shingles are rare (the order decides speed, never results), and parts they are added up in.
COUNTER_BITS, COUNTER_PARTS = 24, 256
#: From this count on the hub of a column comes from a partial minimum, not from its sorted rows.
FREQUENT = 32


def shingles(data: np.ndarray, at: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash) of a block, by row and then by hash."""
    start, end, row = words(data, at)
    h, _ = span_keys(LOWER[data], start, end)
    first, grams = windows(h, row, n)
    owner = row[first]
    count = np.bincount(row, minlength=len(at) - 1)
    begin = np.cumsum(count) - count
    for k in range(1, n):  # shorter texts: the whole sequence
        short = np.flatnonzero(count == k)
        if len(short):
            total = np.zeros(len(short), U)
            for i in range(k):
                total = total * STEP + h[begin[short] + i]
            owner, grams = np.concatenate((owner, short)), np.concatenate((grams, mix(total + U(k))))
    order = np.argsort((owner.astype(U) << U(40)) | (grams >> U(24)))
    if np.any((owner[order][1:] == owner[order][:-1]) & (grams[order][1:] >> U(24) == grams[order][:-1] >> U(24)) & (grams[order][1:] < grams[order][:-1])):
        order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    return owner[new], grams[new]


def least_overlap(n: np.ndarray, jaccard=JACCARD) -> np.ndarray:
    """Smallest overlap that a set of size n needs with any other set to link."""
    a, b = jaccard
    return (a * n + b - 1) // b


def _identity(owner: np.ndarray, g: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit identity of each row's set."""
    size = np.bincount(owner, minlength=rows)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(g), dtype=U)))
    ends = np.cumsum(size)
    return size, mix(sums[ends] - sums[ends - size] + size.astype(U))


def _half(owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mask of the half of each row's shingles with the smallest hashes."""
    return np.arange(len(owner)) - (np.cumsum(size) - size)[owner] < (size[owner] + 1) // 2


def _may_link(owner: np.ndarray, g: np.ndarray, size: np.ndarray, repeated: np.ndarray, jaccard) -> np.ndarray:
    """Rows that the size-derived bound leaves. Rows x and y that link share at least t max(|x|, |y|) shingles, and at most
    (1 - t) of either's are missing in the other; so among x's smaller half (|x| / 2 of them, or fewer if y's half ends
    earlier) at least (t - 1/2) |x| occur in another set's smaller half too, and are in the bitmap of repeated shingles."""
    a, b = jaccard
    some = np.flatnonzero(_half(owner, size))
    shared = np.bincount(owner[some[in_bitmap(repeated, g[some])]], minlength=len(size))
    return (size > 0) & (2 * b * shared >= (2 * a - b) * size)


def _early(n: np.ndarray, jaccard) -> np.ndarray:
    """How many of its first shingles the smaller set of a pair needs: the pair's overlap is at least 2 t n / (1 + t), n its size."""
    a, b = jaccard
    return n - (2 * a * n + a + b - 1) // (a + b) + 1


def _level(total: np.ndarray) -> np.ndarray:
    """Counts as one byte that keeps their order: exact under 128, in steps of a ninth up to 8 million."""
    far = 128 + np.floor(8 * np.log2(np.maximum(total, 128) / 128))
    return np.where(total < 128, total, np.minimum(far, 255)).astype(np.uint8)


def _repeated(df: DataFrame, text_col: str, n: int):
    """Bitmap of the shingles in the smaller half of two different sets or more."""

    def halves(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        owner, g = shingles(data, at, n)
        size, sid = _identity(owner, g, len(at) - 1)
        once = np.zeros(len(size), bool)
        once[np.unique(sid, return_index=True)[1]] = True
        return g[_half(owner, size) & once[owner]]

    return repeated_seeds(df, text_col, halves)


def _frequencies(df: DataFrame, text_col: str, n: int, jaccard, repeated):
    """Broadcast array of counters: in how many of the rows that are left shingles with these leading bits occur, as a :func:`_level`.

    The array has a fixed size. Counters that several shingles share only make the common order less good.
    """
    shift, per = U(64 - COUNTER_BITS), (1 << COUNTER_BITS) // COUNTER_PARTS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(0))
            for lo, hi in blocks(at):
                owner, g = shingles(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], n)
                size, sid = _identity(owner, g, hi - lo)
                once = np.zeros(hi - lo, bool)
                once[np.unique(sid, return_index=True)[1]] = True
                g = np.sort(g[(_may_link(owner, g, size, repeated.value, jaccard) & once)[owner]] >> shift).astype(np.uint32)
                cut = np.searchsorted(g, np.arange(COUNTER_PARTS + 1, dtype=np.int64) * per)
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([g[cut[k]:cut[k + 1]].tobytes() for k in full], pa.binary())], ["part", "held"])

    def told(part: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_level(total).tobytes()], pa.binary())], ["part", "held"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for b in batches:
            for p, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != part:
                    if total is not None:
                        yield told(part, total)
                    part, total = p, np.zeros(per, np.int64)
                total += np.bincount(np.frombuffer(held, np.uint32).astype(np.int64) - p * per, minlength=per)
        if total is not None:
            yield told(part, total)

    sums = df.select(F.col(text_col).cast("string")).mapInArrow(gather, "part int, held binary").repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, held binary")
    counters = np.zeros(1 << COUNTER_BITS, np.uint8)
    for p, held in sums.toLocalIterator():  # 16 MB in all
        counters[p * per:(p + 1) * per] = np.frombuffer(bytes(held), np.uint8)
    return df.sparkSession.sparkContext.broadcast(counters)


def _rows(df: DataFrame, id_col: str, text_col: str, n: int, jaccard, repeated, counters) -> DataFrame:
    """id, sid (hash of the set), n, and, for the rows that are left, the set's prefix in the order of (count, hash): rare
    shingles, and those that many rows have; the first ``rare_early`` and ``often_early`` of them are the prefix of a smaller set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets of this task: a copy's columns are the same
        for b in batches:
            data, at = text_bytes(b.column(1))
            ids = b.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)  # a row without an id takes no part
            for lo, hi in blocks(at):
                owner, g = shingles(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], n)
                rows = hi - lo
                size, sid = _identity(owner, g, rows)
                fresh = np.array([k and x not in seen and not seen.add(x) for k, x in zip(known[lo:hi].tolist(), sid.tolist())], bool)
                want = np.where(_may_link(owner, g, size, repeated.value, jaccard) & fresh, size - least_overlap(size, jaccard) + 1, 0)
                some = np.flatnonzero((want > 0)[owner])
                s_owner, s_g = owner[some], g[some]
                count = counters.value[(s_g >> U(64 - COUNTER_BITS)).astype(np.int64)]
                order = np.argsort((s_owner << 8) | count, kind="stable")  # inside a row by hash already
                held = np.bincount(s_owner, minlength=rows)
                first = order[spread(np.cumsum(held) - held, want)]
                early = np.arange(len(first)) - np.repeat(np.cumsum(want) - want, want) < np.repeat(_early(size, jaccard), want)
                # a shingle that one row has can link nothing
                early, first = early[count[first] > 1], first[count[first] > 1]
                many = count[first] >= FREQUENT
                r_g, o_g = s_g[first[~many]], s_g[first[many]]
                take, more, take_early, more_early = (np.bincount(s_owner[first[m]], minlength=rows) for m in (~many, many, ~many & early, many & early))
                zero = np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, rows).cast(pa.int64()), pa.array(sid.view(np.int64)), pa.array(size, pa.int64()),
                    lists(r_g.view(np.int64), np.concatenate((zero, np.cumsum(take)))),
                    lists(o_g.view(np.int64), np.concatenate((zero, np.cumsum(more)))),
                    pa.array(take_early, pa.int64()), pa.array(more_early, pa.int64())], ["id", "sid", "n", "rare", "often", "rare_early", "often_early"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        make, "id long, sid long, n long, rare array<long>, often array<long>, rare_early long, often_early long")


def _group(label: np.ndarray, i: int, others: np.ndarray) -> None:
    """Joins the components of ``others`` with that of i."""
    for old in np.unique(label[others]):
        if old != label[i]:
            label[label == old] = label[i]


def block_links(sets: list[np.ndarray], jaccard=JACCARD, early: np.ndarray | None = None, side: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect the rows of a block as all its links would, and each row's component.

    ``early``: one row of a pair must be among these at least. ``side``: only rows of different sides (0, 1) are compared.
    """
    a, b = jaccard
    n = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    links: list[tuple[int, int]] = []
    live = np.flatnonzero(n > 0)
    need = least_overlap(n, jaccard)
    while True:  # rows whose shared columns cannot reach their bound leave, and their columns with them
        if len(live) < 2:
            return links, label
        flat = np.concatenate([sets[i] for i in live])
        owner = np.repeat(np.arange(len(live)), n[live])
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        stay = np.bincount(owner[shared], minlength=len(live)) >= need[live]
        if stay.all():
            break
        live = live[stay]
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    size, own = n[live], np.arange(len(live))
    begin = np.searchsorted(owner, np.arange(len(live) + 1))
    may = np.ones(len(live), bool) if early is None else early[live]
    other = None if side is None else side[live]
    order = range(len(live)) if other is None else np.flatnonzero(other == (2 * np.count_nonzero(other) < len(live)))
    mask = np.zeros(column.max() + 1, bool)
    for p in order:
        open_ = (own != own[p]) & (size * a <= size[p] * b) & (size[p] * a <= size * b)
        if not may[p]:
            open_ &= may
        if other is None:
            open_[:p] = False
        else:
            open_ &= other != other[p]
        if not open_.any():
            continue
        mask[column[begin[p]:begin[p + 1]]] = True
        overlap = np.bincount(owner[mask[column]], minlength=len(live))
        mask[column[begin[p]:begin[p + 1]]] = False
        hit = np.flatnonzero(open_ & (b * overlap >= a * (size[p] + size - overlap)))
        links += [(int(live[p]), int(live[q])) for q in hit]
        _group(own, p, hit)
    label[live] = live[own]
    return links, label


def _product(jaccard):
    """Task over rows (hub, lo, hi, side, early, id, set, sid) sorted by hub, lo, hi and sid: emits the links of each block (lo = hi) or tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, last, ids, sets, first, sides = None, None, [], [], [], []

        def done():
            links, _ = block_links(sets, jaccard, np.array(first, bool), None if held_key[1] == held_key[2] else np.array(sides))
            if links:
                x, y = np.array([[ids[i], ids[j]] for i, j in links], np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), held_key[0], np.int64))], ["a", "b", "hub"])

        for b in batches:
            hub, lo, hi, side, early, who = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            data, at = text_bytes(b.column(6))
            sid = b.column(7).to_numpy()
            for i in range(b.num_rows):
                key = (hub[i], lo[i], hi[i])
                if key != held_key:
                    if len(sets) > 1:
                        yield from done()
                    held_key, ids, sets, first, sides = key, [], [], [], []
                elif sid[i] == last:  # the bitmap also lets a copy of a set through now and then
                    continue
                last = sid[i]
                ids.append(who[i])
                first.append(bool(early[i]))
                sides.append(int(side[i]))
                sets.append(np.frombuffer(data[at[i]:at[i + 1]].tobytes(), U))
        if len(sets) > 1:
            yield from done()

    return run


def _members(some: DataFrame) -> DataFrame:
    """(hub, sid, early): the rows that meet at each hub, and whether a row has a column of it in the prefix of a smaller set."""
    # a rare column has few rows, which meet; a frequent column has its hub from one partial minimum, and no rows are gathered for it
    column = Window.partitionBy("g")
    rare = some.select(F.posexplode("rare").alias("i", "g"), "sid", "rare_early").select("g", "sid", (F.col("i") < F.col("rare_early")).alias("early"))
    rare = rare.select(F.min("sid").over(column).alias("hub"), F.max("sid").over(column).alias("top"), F.max("early").over(column).alias("any"), "sid", "early")
    rare = rare.filter("hub <> top AND any").select("hub", "sid", "early")
    often = some.select(F.posexplode("often").alias("i", "g"), "sid", "often_early").select("g", "sid", (F.col("i") < F.col("often_early")).alias("early"))
    hubs = stored(often.groupBy("g").agg(F.min("sid").alias("hub"), F.max("early").alias("any")).filter("any").drop("any"), "join-hubs")  # a table, so that the join can split a hot column
    often = often.join(hubs, "g").select("hub", "sid", "early")
    return rare.unionByName(often).groupBy("hub", "sid").agg(F.max("early").alias("early"))


def _tiles(where: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """(hub, lo, hi, side, early, rep, sid): the tiles in which the strays of a hub meet its other rows.

    ``where``: (hub, rep, sid, n, early, stray). Rows are of four kinds: strays with an early column (0) and others (1), rows of the
    largest component with one (2) and others (3). Each kind is dealt to groups of half a block; 0 meets all, 1 also 2.
    """
    where = where.withColumn("kind", F.when(F.col("stray"), 0).otherwise(2) + F.when(F.col("early"), 0).otherwise(1))
    sums = []
    for k in range(4):
        own = F.col("kind") == k
        rows, words_ = F.sum(F.when(own, 1).otherwise(0)), F.sum(F.when(own, F.col("n")).otherwise(0))
        sums.append(F.ceil(F.greatest(2 * rows / block_rows, 2 * words_ / block_shingles)).cast("int").alias(f"m{k}"))
    groups = stored(where.groupBy("hub").agg(*sums).filter("m0 + m1 > 0"), "join-groups")  # a table, so that the join can split a large hub
    m = [F.col(f"m{k}") for k in range(4)]
    base = [F.lit(0), m[0], m[0] + m[1], m[0] + m[1] + m[2]]
    pick = lambda values: F.element_at(F.array(*values), F.col("kind") + 1)
    upto = lambda first, n: F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<int>"))
    met = [upto(F.lit(0), base[3] + m[3]), F.concat(upto(F.lit(0), m[0]), upto(base[2], m[2])), upto(F.lit(0), base[2]), upto(F.lit(0), m[0])]
    own = where.join(groups, "hub").withColumn("own", (pick(base) + F.pmod(F.xxhash64("sid"), pick(m))).cast("int"))
    chosen = F.when(F.col("kind") == 0, met[0]).when(F.col("kind") == 1, met[1]).when(F.col("kind") == 2, met[2]).otherwise(met[3])
    return own.withColumn("o", F.explode(chosen)).select(
        "hub", F.least("own", "o").alias("lo"), F.greatest("own", "o").alias("hi"), (F.col("own") > F.col("o")).cast("int").alias("side"), "early", "rep", "sid")


def _sets_of(df: DataFrame, id_col: str, text_col: str, n: int, wanted) -> DataFrame:
    """(s2, set as packed 64-bit hashes) of the documents whose id is in the bitmap (and a few more)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_bitmap(wanted.value, b.column(0).fill_null(0).to_numpy()) & ~b.column(0).is_null().to_numpy(zero_copy_only=False)))
            data, at = text_bytes(b.column(1))
            for lo, hi in blocks(at):
                owner, g = shingles(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], n)
                size, sid = _identity(owner, g, hi - lo)
                ends = np.concatenate(([0], np.cumsum(size))) * 8
                yield pa.RecordBatch.from_arrays([pa.array(sid.view(np.int64)), binary(g, ends)], ["s2", "held"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(make, "s2 long, held binary")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, jaccard=JACCARD,
            block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """id, n_shingles and component_id (smallest id reachable by links) of every row of ``df``."""
    repeated = _repeated(df, text_col, n)
    counters = _frequencies(df, text_col, n, jaccard, repeated)
    table = stored(_rows(df, id_col, text_col, n, jaccard, repeated, counters), "join-rows")
    some = table.filter("n > 0 AND id IS NOT NULL")
    reps = some.groupBy("sid").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    member = stored(_members(some).join(reps, "sid").select("hub", "sid", "rep", "n", "early"), "join-members")
    sizes = stored(member.groupBy("hub").agg(F.count("*").alias("k"), F.sum("n").alias("s")).filter("k > 1"), "join-sizes")  # as join-hubs
    member = member.join(sizes, "hub")
    member = member.withColumn("blocks", F.ceil(F.greatest(F.col("k") / block_rows, F.col("s") / block_shingles)).cast("int"))
    wanted = bitmap_of(member, F.col("rep"), bits_for(member.select("rep").distinct().count()))
    sets = _sets_of(df, id_col, text_col, n, wanted)
    carried = F.when(F.col("sid") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")))
    placed = member.select("hub", F.explode(carried).alias("lo"), "early", "rep", "sid").select("hub", "lo", F.col("lo").alias("hi"), F.lit(0).alias("side"), "early", "rep", "sid")

    def multiply(who: DataFrame) -> DataFrame:
        full = who.join(sets, F.col("sid") == F.col("s2")).select("hub", "lo", "hi", "side", "early", "rep", "held", "sid")
        return full.repartition("hub", "lo", "hi").sortWithinPartitions("hub", "lo", "hi", "sid").mapInArrow(_product(jaccard), "a long, b long, hub long")

    links = checkpointed(multiply(placed))
    large = member.filter("blocks > 1")
    if not large.isEmpty():  # rows outside their hub's largest component are compared with all its rows
        so_far = components(links.select("a", "b"))
        where = stored(large.join(so_far, F.col("rep") == F.col("node"), "left").select("hub", "rep", "sid", "n", "early", F.coalesce("component", "rep").alias("c")), "join-large")
        most = stored(where.groupBy("hub", "c").agg(F.count("*").alias("k2")).groupBy("hub").agg(F.max_by("c", "k2").alias("main")), "join-main")
        where = stored(where.join(most, "hub").select("hub", "rep", "sid", "n", "early", (F.col("c") != F.col("main")).alias("stray")), "join-strays")
        links = links.unionByName(checkpointed(multiply(_tiles(where, block_rows, block_shingles))))
    found = components(links.select("a", "b")).withColumnRenamed("node", "rep")
    label = reps.join(found, "rep", "left").select("sid", F.coalesce("component", "rep").alias("component"))
    return table.select("id", "sid", "n").join(label.select(F.col("sid").alias("s2"), "component"), (F.col("sid") == F.col("s2")) & (F.col("n") > 0), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``df`` that stay: of each group of linked documents the one with the smallest id."""
    gone = similar(df, id_col, text_col, **params).filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct()
    return df.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
