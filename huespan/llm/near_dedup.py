"""3. Near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Documents with equal sets are one class, known by a hash of the set.
A class has a min-hash signature of COORDINATES values; a (coordinate, value) pair is a posting list.

Prefix: two classes that agree in MATCHES coordinates must meet in one of the rarest (shared - MATCHES + 1) pairs of either,
pairs ordered by how many classes hold them and pairs that one class holds left out. Only those are posted, so a passage that
many documents share, whose pairs are frequent, is posted by few of them, and most documents aren't posted at all.

Merge: members of a posting list carry their signatures, so the collisions of two of them in all lists are counted where they first meet; MATCHES of them, fitting sizes and
enough agreement of a longer sketch (SKETCH coordinates of a bit each, made for posted classes only) make a candidate pair.

Skip: in the first pass a class is compared with a leader of the list only; if it passes it is skipped from then
on, else it waits for the next leader. Of the leaders that a class met, FEW are confirmed with it, so n near copies give FEW * n pairs at most, in however many lists they meet. In a second pass over the lists that still hold several components, members of the
largest component meet only those outside it, and these each other; a pair counts in the list of the first pair of the prefixes that both hold, so once. No link between
different texts is lost, while copies are never expanded into all pairs.

Confirmation: candidate pairs are gathered to cells of two blocks of classes, blocks of the classes that share a frequent pair; a class's full set travels once
to each cell that it has pairs in, not once for each pair, and a cell counts common shingles for one class against all others at once. A block grows with the root of its list, so what travels
for a family of n documents just below the threshold grows with n to the power of 1.5.

A pair with similarity of exactly 0.75 is missed by the signature with a chance of about 5e-5, more similar ones with far less.

Null or wordless texts: n_shingles 0, linked with nothing. A null doc_id takes no part: component_id null, kept false.
Rows that repeat a doc_id are judged by their texts: each text has its own links, and as a document reaches what any of its texts reaches, components that share a
doc_id are one. keep_one_of_each() goes by texts alone: one row of each group of linked texts stays, so a text that stands alone isn't lost. Ties don't arise, as
the smallest doc_id and then the smaller hash decide. Very long texts are one row's work. Other columns, whatever their names, don't matter. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huespan.llm.common import drop_materialized, materialize
from huespan.llm.components import components

WORDS, PERCENT = 5, 75
COORDINATES, MATCHES = 32, 14
#: Bits of a sketch, one for each of as many minima, and in how many two sketches agree at least if the similarity is 0.75: seven eighths do
#: on average, and this lies 4.6 standard deviations below.
SKETCH, SKETCH_MATCHES = 2048, 1723
#: Most members of a posting list that one task takes at once in the first pass; longer lists are dealt in blocks. How many leaders it tries.
BLOCK = 512
LEADERS = 24
#: Leaders that a class is confirmed with in the first pass, of those that it met in its lists. More would only join it again; what these leave apart is the second pass's.
FEW = 4
#: In the second pass a list of n members is dealt in the root of n / CROSS blocks; in confirmation classes are dealt in the root of n / CELL, so that no block has more than BLOCK_MOST
#: classes or BLOCK_BYTES of sets.
CROSS, CELL, BLOCK_MOST, BLOCK_BYTES = 256, 64, 2048, 16 << 20
#: Pairs that a task holds before it passes them on.
CELL_PAIRS = 200_000
#: Rows at most, of 64 bits, in the table that tells texts which aren't posted.
BIT_WORDS = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20240229)
_ADD = _random.integers(0, 1 << 32, SKETCH, dtype=np.uint32)
_MUL = _random.integers(0, 1 << 32, SKETCH, dtype=np.uint32) | np.uint32(1)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - WORDS + 1
    s = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        s = _scramble(s * _MIX + h[k : k + n])
    return np.unique(s)


def minima(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The least 32-bit value of a set in each of the first coordinates."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 256):
        part = low[at : at + 256]
        least = np.minimum(least, ((part[None, :] ^ _ADD[:coordinates, None]) * _MUL[:coordinates, None]).min(axis=1))
    return least


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A bit of the minimum of every coordinate."""
    least = minima(shingles, SKETCH)
    for k in (16, 8, 4, 2, 1):  # its parity
        least = least ^ (least >> np.uint32(k))
    return np.packbits((least & np.uint32(1)).astype(np.uint8))


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set and its signature (null if empty)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py()) for text in batch.column(1)]
            n = [len(x) for x in sets]
            h1, h2 = ([set_hash(x, seed) for x in sets] for seed in (1, 2))
            sig = [minima(x, COORDINATES).tobytes() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return docs.mapInArrow(work, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _tokens(classes: DataFrame) -> DataFrame:
    """(ck, token): a row for each coordinate of each class; the token holds coordinate and value."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                ck, sig = batch.column(0).slice(at, 2000), batch.column(1).slice(at, 2000).to_pylist()
                values = np.frombuffer(b"".join(sig), dtype=np.uint32).reshape(-1, COORDINATES).astype(np.int64) + place
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ck.to_numpy(zero_copy_only=False), COORDINATES)), pa.array(values.ravel())], ["ck", "token"])

    return classes.select("ck", "sig").mapInArrow(work, "ck long, token long")


def _sketches_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of sketches as 64-bit words."""
    return SKETCH - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) >= SKETCH_MATCHES


def _sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches: groups are runs of equal leading columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, dtype=bool)
        for k in range(keys):
            col = batch.column(k).to_numpy(zero_copy_only=False)
            same &= col == col[-1]
        start = batch.num_rows - (int(np.argmin(same[::-1])) if not same.all() else batch.num_rows)  # where the last run begins
        if held and (start > 0 or any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(keys))):
            if start > 0:
                held.append(batch.slice(0, start))
                yield pa.Table.from_batches(held)
                held = [batch.slice(start)]
            else:
                yield pa.Table.from_batches(held)
                held = [batch]
        elif start > 0:
            yield pa.Table.from_batches([batch.slice(0, start)])
            held = [batch.slice(start)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    """For each row, the first row of its group."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in range(keys):
        col = table.column(k).to_numpy()
        new[1:] |= col[1:] != col[:-1]
    at = np.flatnonzero(new)
    return np.repeat(at, np.diff(np.append(at, table.num_rows)))


#: Rows of a cell (ha, hb), the blocks of two classes: kind 0, a class (a) that has pairs in it; kind 1, a class (a) and those (bs) that it is paired with.
CELLS = pa.schema([("ha", pa.int64()), ("hb", pa.int64()), ("kind", pa.int32()), ("a", pa.int64()), ("bs", pa.list_(pa.int64()))])
CELLS_SQL = "ha long, hb long, kind int, a long, bs array<long>"


def _cells(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of cells from (class, its block, classes, their blocks)."""
    ha, hb, a, bs = [], [], [], []
    for x, home, ys, homes in found:
        order = np.argsort(homes, kind="stable")
        cuts = np.flatnonzero(np.diff(homes[order])) + 1
        for part in np.split(order, cuts):
            other = int(homes[part[0]])
            ha.append(min(home, other))
            hb.append(max(home, other))
            a.append(x)
            bs.append(ys[part])
    size = [len(x) for x in bs]
    member = np.unique(np.array([np.concatenate([np.repeat(ha, size), ha]), np.concatenate([np.repeat(hb, size), hb]), np.concatenate([*bs, a])], dtype=np.int64), axis=1)
    k = member.shape[1]
    ends = np.cumsum([0] * (k + 1) + size).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bs), pa.int64()))
    columns = [pa.array(np.concatenate([m, x]), pa.int64()) for m, x in zip(member, (ha, hb, a), strict=True)]
    return pa.RecordBatch.from_arrays([*columns[:2], pa.array(np.repeat([0, 1], [k, len(a)]), pa.int32()), columns[2], lists], schema=CELLS)


def _leader_pairs(postings: DataFrame) -> DataFrame:
    """First pass: cells of pairs of a leader and a member of a posting list that collide often enough, sketches and sizes fitting."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            start = _starts(table, 2)
            ck, home, n = (table.column(c).to_numpy() for c in ("ck", "home", "n"))
            sig = _matrix(table.column("sig").combine_chunks(), 4 * COORDINATES).view(np.uint32)
            sk = _matrix(table.column("sk").combine_chunks(), SKETCH // 8).view(np.uint64)
            rows = np.arange(table.num_rows)
            leader = start.copy()
            for _ in range(LEADERS):
                rows = rows[rows != leader[rows]]
                if not len(rows):
                    break
                at = leader[rows]
                ok = _sizes_fit(n[rows], n[at]) & ((sig[rows] == sig[at]).sum(axis=1) >= MATCHES)
                ok[ok] = _sketches_fit(sk[rows[ok]], sk[at[ok]])
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ck[rows[ok]], home[rows[ok]], ck[at[ok]], home[at[ok]])], ["ck", "home", "leader", "its"])
                rows = rows[~ok]
                if not len(rows):
                    break
                group = start[rows]  # the next leader of a list is the first member that is left
                first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                leader[rows] = np.repeat(rows[first], np.diff(np.append(first, len(rows))))

    dealt = postings.select("token", "block", "ck", "home", "n", "sig", "sk").repartition("token", "block").sortWithinPartitions("token", "block", "ck")
    met = dealt.mapInArrow(work, "ck long, home long, leader long, its long")
    # A class has as many rows as lists at most. All choose by one order, so those of a family choose alike.
    choice = F.slice(F.sort_array(F.collect_set(F.struct(F.xxhash64("leader").alias("place"), "leader", "its"))), 1, FEW)
    x = met.groupBy("ck", "home").agg(choice.alias("few")).select("ck", "home", F.explode("few").alias("x")).select("ck", "home", "x.leader", "x.its")
    cell = [F.least("home", "its").alias("ha"), F.greatest("home", "its").alias("hb")]
    one = x.select(*cell, F.lit(1).alias("kind"), F.col("ck").alias("a"), F.array("leader").alias("bs"))
    return one.unionByName(x.select(*cell, F.lit(0).alias("kind"), F.explode(F.array("ck", "leader")).alias("a"), F.array().cast("array<long>").alias("bs")).distinct())


def _cross_pairs(postings: DataFrame) -> DataFrame:
    """Second pass: cells of pairs of a posting list from different components that collide often enough, sketches and sizes fitting.

    postings: token, within, i, j (two blocks of the list; within: both of classes outside the largest component, i <= j), mine (the row's own block, or
    if not within, 0 for outside the largest component and 1 for in it), ck, home, n, sig, mask (the coordinates of its prefix, as bits), sk, comp.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 4):
            start = _starts(table, 4)
            within, i, j, mine = (table.column(c).to_numpy() for c in ("within", "i", "j", "mine"))
            ck, home, n, comp, token = (table.column(c).to_numpy() for c in ("ck", "home", "n", "comp", "token"))
            sig = _matrix(table.column("sig").combine_chunks(), 4 * COORDINATES).view(np.uint32)
            posted = (table.column("mask").to_numpy()[:, None] >> np.arange(COORDINATES) & 1).astype(bool)
            sk = _matrix(table.column("sk").combine_chunks(), SKETCH // 8).view(np.uint64)
            bounds = np.append(np.unique(start), table.num_rows)
            out, held = [], 0
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo < 2:
                    continue
                place = token[lo] >> 32
                sides = (i[lo], j[lo]) if within[lo] else (0, 1)
                left, right = (lo + np.flatnonzero(mine[lo:hi] == x) for x in sides)
                twice = bool(within[lo]) and i[lo] == j[lo]
                for k, x in enumerate(left):
                    others = right[k + 1 :] if twice else right
                    others = others[(comp[others] != comp[x]) & _sizes_fit(n[others], n[x])]
                    if not len(others):
                        continue
                    same = sig[others] == sig[x]
                    first = (same & posted[others] & posted[x]).argmax(axis=1) == place
                    others = others[first & (same.sum(axis=1) >= MATCHES)]
                    if len(others) and len(ys := others[_sketches_fit(sk[others], sk[x])]):
                        out.append((int(ck[x]), int(home[x]), ck[ys], home[ys]))
                        held += len(ys)
                        if held > CELL_PAIRS:
                            yield _cells(out)
                            out, held = [], 0
            if out:
                yield _cells(out)

    keys = ["token", "within", "i", "j"]
    return postings.select(*keys, "mine", "ck", "home", "n", "sig", "mask", "sk", "comp").repartition(*keys).sortWithinPartitions(*keys, "ck").mapInArrow(work, CELLS_SQL)


def _similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sets (by their places, ascending a) are similar enough."""
    size = np.array([len(x) for x in sets])
    both = np.zeros(len(a), dtype=np.int64)
    if len(a) <= 2 * len(sets):
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            both[k] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
    else:
        names, number = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        starts, seen = ends - size, np.zeros(len(names), dtype=bool)
        bounds = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            x, ys = a[lo], b[lo:hi]
            own = number[starts[x] : ends[x]]
            seen[own] = True
            if 4 * len(ys) < len(sets):
                both[lo:hi] = [np.count_nonzero(seen[number[starts[y] : ends[y]]]) for y in ys]
            else:
                both[lo:hi] = np.add.reduceat(seen[number], starts, dtype=np.int64)[ys]
            seen[own] = False
    return 100 * both >= PERCENT * (size[a] + size[b] - both)


def _confirmed(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of written rows of cells whose full sets are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            start = _starts(table, 2)
            bounds = np.append(np.unique(start), table.num_rows)
            kind, a = (table.column(c).to_numpy() for c in ("kind", "a"))
            data, bs = table.column("shingles"), table.column("bs")
            out_a, out_b = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                cut = lo + int(np.searchsorted(kind[lo:hi], 1))
                held = [np.frombuffer(data[k].as_buffer(), dtype=np.uint64) for k in range(lo, cut)]  # in order of their classes
                lists = bs.slice(cut, hi - cut).combine_chunks()
                size = lists.value_lengths().to_numpy(zero_copy_only=False)
                pa_, pb = np.repeat(a[cut:hi], size), lists.flatten().to_numpy()
                x, y = np.searchsorted(a[lo:cut], pa_), np.searchsorted(a[lo:cut], pb)
                ok = _similar(held, x, y)
                out_a.append(pa_[ok])
                out_b.append(pb[ok])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_a, out_b)], ["a", "b"])

    needed = cells.where("kind = 0").select("ha", "hb", F.col("a").alias("ck")).distinct().hint("merge").join(sets.select("ck", "shingles"), "ck")
    none = F.lit(None).cast("binary")
    rows = needed.select("ha", "hb", F.lit(0).alias("kind"), F.col("ck").alias("a"), F.array().cast("array<long>").alias("bs"), "shingles")
    rows = rows.unionByName(cells.where("kind = 1").withColumn("shingles", none))
    return rows.repartition("ha", "hb").sortWithinPartitions("ha", "hb", "kind", "a").mapInArrow(work, "a long, b long")


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _flagged(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (doc_id, ...) with `near`: false for rows whose doc_id isn't among ids, true for those that are, and a few others.

    Few of the texts are needed where only they would have to be shuffled. The flags come from a table of bits of fixed size, which may be
    broadcast whatever the number of ids; the more there are, the more others are flagged, and the join that follows drops those."""
    word, bit = F.pmod(F.xxhash64("doc_id"), F.lit(BIT_WORDS)), _bit(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)))
    bits = ids.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = rows.withColumn("word", word).join(F.broadcast(bits), "word", "left")
    hit = F.col("doc_id").isNotNull() & (F.coalesce("bits", F.lit(0).cast("long")).bitwiseAND(bit) != 0)
    return found.withColumn("near", hit).drop("word", "bits")


def set_hash(shingles: np.ndarray, seed: int) -> int | None:
    """A signed 64-bit hash of a set; null for the empty one."""
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes(), seed) - (1 << 63) if len(shingles) else None


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ck, shingles, sk) for the classes in wanted (rep, ck)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cks, out, sk = [], [], []
            for want, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_py())
                if set_hash(s, 1) == want:  # else a row that repeats the id with another text
                    cks.append(want)
                    out.append(s.tobytes())
                    sk.append(sketch(s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cks, pa.int64()), pa.array(out, pa.binary()), pa.array(sk, pa.binary())], ["ck", "shingles", "sk"])

    wanted = wanted.select(F.col("rep").alias("doc_id"), "ck")
    near = _flagged(docs, wanted).where("near").select("doc_id", "text")
    return near.hint("merge").join(wanted, "doc_id").select("ck", "text").mapInArrow(work, "ck long, shingles binary, sk binary").dropDuplicates(["ck"])


def _blocks(size: Column, each: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(size / each))).cast("long")


def _home(pairs: Column, ck: Column, n: Column) -> Column:
    """The block of a class in confirmation: by a posted pair that is about as frequent as its most frequent one, the first in an order that all share, so that most of a family
    agree; and by its place among the many that have that pair."""
    most = F.array_max(F.transform(pairs, lambda p: p.cnt))
    of = F.array_min(F.transform(F.filter(pairs, lambda p: 2 * p.cnt >= most), lambda p: F.struct(F.xxhash64(p.token).alias("place"), p.token.alias("token"), p.cnt.alias("cnt"))))
    sized = F.pow(F.lit(2.0), F.ceil(F.log2(F.ceil(of["cnt"] * n * 8 / BLOCK_BYTES).cast("double"))))  # few different numbers, so that members of a list agree
    blocks = F.greatest(_blocks(of["cnt"], CELL), F.ceil(of["cnt"] / BLOCK_MOST).cast("long"), sized.cast("long"))
    return F.xxhash64(of["token"], blocks, F.pmod(F.xxhash64(ck, F.lit(7)), blocks))


def _linked(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (doc_id, text): features of all rows, their classes (ck, h2, rep, n, sig), and (node, root) of linked classes."""
    features = materialize(_features(rows), "features")
    known = features.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    grouped = known.groupBy(F.col("h1").alias("ck"), "h2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"))
    classes = materialize(grouped, "classes")
    # Prefixes: a class's shared pairs, rarest first, less the last MATCHES - 1.
    tokens = _tokens(classes)
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    shared = tokens.hint("merge").join(held, "token").groupBy("ck").agg(F.sort_array(F.collect_list(F.struct("cnt", "token"))).alias("pairs"))
    prefix = shared.where(F.size("pairs") >= MATCHES).select("ck", F.slice("pairs", F.lit(1), F.size("pairs") - MATCHES + 1).alias("pairs"))
    # Of those, the ones that two classes have posted.
    posted = prefix.select("ck", F.explode("pairs.token").alias("token"))
    met = posted.groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    live = posted.join(met, "token").groupBy("ck").agg(F.collect_list(F.struct("cnt", "token")).alias("pairs"))
    mask = F.aggregate("pairs", F.lit(0).cast("long"), lambda bits, p: bits.bitwiseOR(_bit(F.shiftright(p.token, 32))))
    posted = materialize(live.join(classes, "ck").select("ck", "rep", "n", "sig", "pairs", mask.alias("mask"), _home(F.col("pairs"), F.col("ck"), F.col("n")).alias("home")), "posted")
    sets = materialize(_shingle_sets(rows, posted.select("rep", "ck")), "sets")
    sketched = posted.join(sets.select("ck", "sk"), "ck")
    # Each list is dealt in another way, so the leaders' pairs of several lists join what one list's blocks part.
    block = F.pmod(F.xxhash64("ck", "token"), F.ceil(F.col("cnt") / BLOCK).cast("long"))
    postings = sketched.select("ck", "home", "n", "sig", "sk", F.explode("pairs").alias("p")).select("p.token", "p.cnt", "ck", "home", "n", "sig", "sk")
    pairs = materialize(_leader_pairs(postings.withColumn("block", block)), "pairs")
    first = materialize(_confirmed(pairs, sets), "links")
    roots = components(first)
    # Second pass: lists that still hold several components.
    labelled = materialize(posted.join(roots.withColumnRenamed("node", "ck"), "ck", "left").withColumn("comp", F.coalesce("root", "ck")).drop("root", "rep"), "labelled")
    each = labelled.select("ck", "comp", F.explode("pairs.token").alias("token")).groupBy("token", "comp").agg(F.count(F.lit(1)).alias("in_comp"))
    lists = each.groupBy("token").agg(F.max_by("comp", F.struct("in_comp", "comp")).alias("largest"), F.max("in_comp").alias("inside"), F.sum("in_comp").alias("cnt"), F.count(F.lit(1)).alias("comps"))
    mixed = lists.where("comps > 1").select("token", "largest", _blocks(F.col("cnt") - F.col("inside"), CROSS).alias("outer"), _blocks(F.col("inside"), CROSS).alias("inner"))
    members = labelled.join(sets.select("ck", "sk"), "ck").select("ck", "home", "n", "sig", "mask", "sk", "comp", F.explode("pairs.token").alias("token")).join(mixed, "token")
    own = lambda blocks: F.pmod(F.xxhash64("ck", "token"), F.col(blocks))
    upto = lambda blocks: F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)
    cell = lambda within, i, j, mine: F.struct(F.lit(within).alias("within"), i.alias("i"), j.alias("j"), mine.cast("long").alias("mine"))
    here = F.transform(upto("outer"), lambda i: cell(0, i, own("inner"), F.lit(1)))
    outside = F.concat(F.transform(upto("inner"), lambda j: cell(0, own("outer"), j, F.lit(0))), F.transform(upto("outer"), lambda x: cell(1, F.least(x, own("outer")), F.greatest(x, own("outer")), own("outer"))))
    full = members.withColumn("cell", F.explode(F.when(F.col("comp") == F.col("largest"), here).otherwise(outside)))
    more = materialize(_cross_pairs(full.select("*", "cell.*").drop("cell")), "pairs")
    if not more.isEmpty():
        second = materialize(_confirmed(more, sets), "links")
        if not second.isEmpty():
            old, links = roots, first.unionByName(second)
            roots = components(links)
            drop_materialized(old)
        drop_materialized(second)
    for done in (posted, sets, pairs, first, labelled, more):
        drop_materialized(done)
    return features, classes, roots


def _named(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(ck, h2, component): the smallest doc_id of each class's component."""
    of = roots.select(F.col("node").alias("ck"), "root")
    least = classes.join(of, "ck").groupBy("root").agg(F.min("rep").alias("least"))
    return classes.select("ck", "h2", "rep").join(of.join(least, "root").select("ck", "least"), "ck", "left").select("ck", "h2", F.coalesce("least", "rep").alias("component"))


def _judged(features: DataFrame, named: DataFrame) -> DataFrame:
    """doc_id, n_shingles, ck, component_id for every row of features."""
    linked = features.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).withColumnRenamed("h1", "ck").join(named, ["ck", "h2"]).select("doc_id", "n_shingles", "ck", F.col("component").alias("component_id"))
    alone = features.where(F.col("doc_id").isNull() | (F.col("n_shingles") <= 0)).select("doc_id", "n_shingles", F.col("h1").alias("ck"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id, kept."""
    features, classes, roots = _linked(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    judged = _judged(features, _named(classes, roots))
    # An id that has several texts joins their components.
    several = features.where("doc_id is not null").groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    several = materialize(several, "several")
    if not several.isEmpty():
        edges = judged.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        further = components(edges).select(F.col("node").alias("component_id"), "root")
        judged = judged.join(further, "component_id", "left").withColumn("component_id", F.coalesce("root", "component_id"))
    return judged.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of linked texts, that of its smallest doc_id, all columns kept; rows without an id or words stay, repeated ones once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))
    features, classes, roots = _linked(rows.select("doc_id", "text"))
    judged = _judged(features, _named(classes, roots)).where(F.col("doc_id").isNotNull())
    # By id: whether it stays, how many rows it has, and which of its texts stay (the least of each component that it stands for).
    stays = F.col("doc_id") == F.col("component_id")
    ids = judged.groupBy("doc_id").agg(F.bool_or(stays).alias("stays"), F.count(F.lit(1)).alias("rows"))
    odd = materialize(ids.where(~F.col("stays") | (F.col("rows") > 1)), "odd")  # to be dropped, or repeated
    flagged = _flagged(rows, odd)
    met = flagged.where("near").select("doc_id", "text", "row").hint("merge").join(odd, "doc_id", "left")
    out = flagged.where(~F.col("near")).select("row").unionByName(met.where(F.col("rows").isNull()).select("row"))
    again = odd.where("rows > 1")
    if not again.isEmpty():
        root = roots.select(F.col("node").alias("ck"), "root")
        texts = judged.where(stays).join(again.select("doc_id"), "doc_id", "left_semi").join(root, "ck", "left").withColumn("group", F.coalesce("root", "ck"))
        chosen = texts.groupBy("doc_id", "group").agg(F.min("ck").alias("ck")).select("doc_id", F.coalesce("ck", F.lit(0)).alias("ck"))
        hashed = _hashed(met.where("rows > 1").select("doc_id", "text", "row"))
        one = hashed.join(chosen, ["doc_id", "ck"]).dropDuplicates(["doc_id", "ck"])
        out = out.unionByName(one.select("row"))
    return out.select("row.*").to(docs.schema)


def _hashed(rows: DataFrame) -> DataFrame:
    """Adds ck, the hash of the text's set, 0 for the empty one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ck = pa.array([set_hash(shingle_set(t.as_py()), 1) or 0 for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ck], [*batch.schema.names, "ck"])

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField("ck", T.LongType())]))
