"""Contiguous shards of near equal bytes whose largest is as small as can be, with equal texts kept together.

Texts that are equal form one atomic group. Groups stand in the order of a 64-bit hash of the text, so no shard depends on where a document was stored;
shards are runs of that order. The smallest capacity into which the groups can be filled one after another is found by binary search, each try a greedy filling, and the runs are cut there.

Groups are as many as there are texts, so the driver never sees them all. It holds at most CELLS cells of the order, each with its groups' bytes. A try fills
shards twice over those cells: once as if nothing could be cut inside a cell, once as if everything could, which bounds the capacity from both sides. Only the cells in
which a cut may then lie (they lie in one short run a shard) are divided further, in a further pass over those groups, until both bounds meet; then capacity and greedy cuts are exact.

A group that alone is no smaller than an even share of what is left gets a shard of its own, first, so that one huge group doesn't set the capacity of all others.
Within the capacity a run ends where its share is nearest to an even one, if what follows still fits the shards that are left.

Everything is a DataFrame expression; the cells come back by collect() and go out as literals.

Defined results: a null text is the empty text. Null ids and repeated rows are rows like any others. With fewer groups than shards some shards stay empty. An empty table has no
rows. Texts whose 64-bit hashes agree are treated as one group. Only the two named columns are read, so none can clash; texts of any length are only hashed and measured, and aren't shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huespan.llm.common import materialize

#: Shards, bytes that a row costs beside its text, cells that the driver holds at most.
SHARDS, ROW_BYTES, CELLS = 40, 16, 1 << 16
#: Rows that are numbered in one place, more only where there would be over MOST_BINS such places; and what rows of one cell can be dealt by.
BIN_ROWS, MOST_BINS, SALTS = 1000, 1 << 14, 1 << 14


@dataclass
class Runs:
    """Cells of the order with their last keys, running bytes (one more than cells), and groups."""

    last: list[int] = field(default_factory=list)
    edges: list[int] = field(default_factory=lambda: [0])
    groups: list[int] = field(default_factory=list)

    def reach(self, at: int, capacity: int) -> tuple[int, int]:
        """Where a filling from byte `at` ends: surely (an edge), and at best."""
        k = bisect_right(self.edges, at + capacity) - 1
        if k == len(self.groups) or self.groups[k] == 1:
            return self.edges[k], self.edges[k]
        return self.edges[k], min(at + capacity, self.edges[k + 1] - 1)

    def fits(self, at: int, capacity: int, shards: int) -> bool:
        """Whether what follows byte `at`, an edge, surely goes into so many shards."""
        for _ in range(shards):
            at = self.reach(at, capacity)[0]
        return at >= self.edges[-1]


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, key, salt of each document. The salt is any number; it is fixed once the rows are written."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_column).alias("doc_id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")
    )


def _within(ranges: list[tuple[int, int]] | None) -> Column:
    """Whether a key lies in one of the ranges, which may be one a shard."""
    if ranges is None:
        return F.lit(True)
    out = F.lit(False)
    for low, high in ranges:
        out = out | F.col("key").between(F.lit(low).cast("long"), F.lit(high).cast("long"))
    return out


def _cells(groups: DataFrame, bits: int, ranges: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(last key, bytes, groups) of the cells of equal leading bits in the ranges, in order."""
    found = groups.where(_within(ranges)).groupBy(F.shiftright("key", 64 - bits).alias("cell")).agg(F.max("key").alias("last"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("groups"))
    return sorted((r.last, int(r.bytes), r.groups) for r in found.collect())


def _runs(cells: list[tuple[int, int, int]]) -> Runs:
    out = Runs()
    for last, size, n in cells:
        out.last.append(last)
        out.edges.append(out.edges[-1] + size)
        out.groups.append(n)
    return out


def _bounds(runs: Runs, shards: int) -> tuple[int, int]:
    """The largest capacity that surely isn't enough, plus one, and the smallest that surely is."""

    def at_best(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = runs.reach(at, capacity)[1]
        return at >= runs.edges[-1]

    def least(enough) -> int:
        low, high = 0, runs.edges[-1]
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if enough(mid) else (mid + 1, high)
        return low

    return least(at_best), least(lambda c: runs.fits(0, c, shards))


def smallest_capacity(groups: DataFrame, shards: int, limit: int = CELLS) -> tuple[Runs, int]:
    """Cells, divided where cuts lie, and the smallest capacity for (key, bytes) groups."""
    bits = max(1, limit.bit_length() - 1)
    cells = _cells(groups, bits)
    while True:
        runs = _runs(cells)
        low, high = _bounds(runs, shards)
        if low == high:
            return runs, high
        # Where the end of each shard may lie: between the surest filling at the low capacity and the best one at the high capacity, a span of cells a shard.
        spans: list[list[int]] = []
        sure = best = 0
        for _ in range(shards):
            sure, best = runs.reach(sure, low)[0], runs.reach(best, high)[1]
            first, final = bisect_right(runs.edges, sure) - 1, min(bisect_right(runs.edges, best), len(cells))
            if all(n == 1 for n in runs.groups[first:final]):
                continue
            if spans and first <= spans[-1][1]:
                spans[-1][1] = max(final, spans[-1][1])
            else:
                spans.append([first, final])
        divided = [k for first, final in spans for k in range(first, final)]
        inside = sum(cells[k][2] for k in divided)
        finer_bits = 64 if inside <= limit else min(64, bits + max(1, (limit // len(divided)).bit_length() - 1))
        # A cell that is a group alone may have more leading bits than others; its key bounds it all the same.
        ranges = [(cells[first - 1][0] + 1 if first else -(1 << 63), cells[final - 1][0]) for first, final in spans]
        gone = set(divided)
        cells = sorted([c for k, c in enumerate(cells) if k not in gone] + _cells(groups, finer_bits, ranges))
        bits = finer_bits


def cuts(runs: Runs, capacity: int, shards: int) -> list[int]:
    """The last keys of the runs: within the capacity, each as near to an even share of what is left as an edge and the rest allow."""
    out, at, total = [], 0, runs.edges[-1]
    for k in range(shards - 1):
        end = runs.reach(at, capacity)[0]
        top, fair = bisect_left(runs.edges, end), at + (total - at) / (shards - k)
        low = bisect_left(runs.edges, at)
        near = min(max(bisect_left(runs.edges, fair), low), top)
        if near > low and fair - runs.edges[near - 1] < runs.edges[near] - fair:
            near -= 1
        high = top  # the first edge from `near` on that leaves no more than the other shards hold
        while near < high:
            mid = (near + high) // 2
            near, high = (near, mid) if runs.fits(runs.edges[mid], capacity, shards - k - 1) else (mid + 1, high)
        at = runs.edges[near]
        out.append(runs.last[near - 1] if near else -(1 << 63))
    return out


def plan(groups: DataFrame, shards: int = SHARDS, limit: int = CELLS) -> tuple[list[int], list[int]]:
    """Keys of the groups with a shard of their own, in order of their shards, and the last keys of the runs that follow, but for the last one's."""
    total = groups.agg(F.sum("bytes").alias("s")).first().s
    alone, left = [], int(total or 0)
    for r in groups.orderBy(F.desc("bytes"), "key").limit(shards - 1).collect():
        if r.bytes * (shards - len(alone)) < left:
            break
        alone.append(r.key)
        left -= r.bytes
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    runs, capacity = smallest_capacity(rest, shards - len(alone), limit)
    return alone, cuts(runs, capacity, shards - len(alone))


def with_shards(rows: DataFrame, alone: list[int], ends: list[int]) -> DataFrame:
    """Adds shard, from 0, by the key."""
    run = F.lit(len(alone))
    for end in ends:
        run = run + (F.col("key") > F.lit(end).cast("long")).cast("int")
    for k, key in enumerate(alone):
        run = F.when(F.col("key") == F.lit(key).cast("long"), F.lit(k)).otherwise(run)
    return rows.withColumn("shard", run)


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds slot: places from 0 without gaps in each shard.

    Rows are dealt to bins by shard, leading bits of the key, and salt where a cell holds many rows (a group of copies may be a third of all), counted by bin, and
    numbered within. A bin has about BIN_ROWS rows, and bins are a few times MOST_BINS at most, whose counts go to all rows."""
    total = rows.count()
    size = max(BIN_ROWS, -(-total // MOST_BINS))
    bits = max(1, (total // size).bit_length())
    celled = rows.withColumn("cell", F.shiftright("key", 64 - bits))
    ways = celled.groupBy("cell").agg(F.least(F.lit(SALTS), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias("ways"))  # 2 * MOST_BINS cells at most
    binned = celled.join(F.broadcast(materialize(ways, "ways")), "cell").withColumn("part", F.pmod("salt", "ways")).drop("ways")
    keys = ["shard", "cell", "part"]
    counts = binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, before.alias("before"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("key", "doc_id", "size", "text_crc32"))
    placed = binned.withColumn("own", own).join(F.broadcast(offsets), keys)
    return placed.withColumn("slot", F.col("before") + F.col("own") - 1).drop("cell", "part", "own", "before", "salt")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    rows = materialize(measured(docs), "measured")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    alone, ends = plan(groups, shards)
    placed = with_slots(with_shards(rows, alone, ends))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
