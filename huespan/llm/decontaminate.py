"""5. Benchmark decontamination by greedy string tiling.

Benchmark items and documents are sequences of lower-case words. The windows of MATCH words of the items are the seeds, known by their
Karp-Rabin hashes; a rolling hash over a document's words, of which those that no item has count as breaks, finds the
places where it shares a seed with an item. Seeds in a row on one diagonal are a match. Tiling then takes, again and again, the
longest match left and marks its words in both texts; what an earlier tile covers is cut off from later matches, and what remains
of them must still have MATCH words. The share of an item's words that the tiles cover is its coverage; order and distance of the
tiles don't matter, so reordered passages are caught. From THRESHOLD on, the document is contaminated by the item.

Seeds of a document are met in slices of SLICE pairs, whose runs are joined across slices; of matches with equal item words only as many of the earliest are held as earlier
tiles could spoil, which changes no tile. So memory is bounded by the two texts, however often they repeat themselves. Hash hits are checked word by word.

A benchmark of CHUNK_CHARS characters at most travels to the documents as one index, and documents are never shuffled. A larger one is joined: a table of bits of fixed size tells documents
which of their seeds may be an item's; those seeds meet the rarest seeds of each item (all that a contaminating document could miss at most, and one more) by
an equi-join, and the texts of the candidates that come out are tiled. Items of fewer than MATCH words are matched as a whole.

Null and empty documents and items share nothing. Repeated documents are reported each; repeated items are judged each. Ids may have any type and are passed on; null ones are kept as they
are. Extra columns, whatever their names, don't matter. An empty benchmark leaves every document clean. Ties of length go to the earlier place in the document, then in the item.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from huespan.llm.common import materialize

#: Words of the shortest tile, and the coverage from which a document counts as contaminated.
MATCH, THRESHOLD = 4, 0.5
CHUNK_CHARS = 16_000_000
#: Pairs of a place in the document and a place in the item that are held at once, and rows at most, of 64 bits, of the table of seeds.
SLICE, BIT_WORDS = 1 << 19, 1 << 20

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `width` ids; 0 where a window holds a break (id 0)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h, ok = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for k in range(width):
        part = ids[k : k + n]
        h = h * _BASE + part
        ok &= part != 0
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(ok, h | np.uint64(1), np.uint64(0))


def tile(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document place, item place, words) from maximal matches: the longest first, then the earliest."""
    heap = [(-n, d, i) for d, i, n in matches]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    tiles = []
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -n
        run, whole = 0, []
        for k in range(n + 1):  # stretches that no tile covers yet
            if k < n and d + k not in in_doc and i + k not in in_item:
                run += 1
            else:
                if run >= least:
                    whole.append((k - run, run))
                run = 0
        if whole == [(0, n)]:
            tiles.append((d, i, n))
            in_doc.update(range(d, d + n))
            in_item.update(range(i, i + n))
        else:
            for at, run in whole:
                heapq.heappush(heap, (-run, d + at, i + at))
    return tiles


def _runs(doc: np.ndarray, item: np.ndarray, hashes: np.ndarray, at: np.ndarray, seeds: np.ndarray, places: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Maximal matches (document place, item place, words) of an item in a document.

    doc, item: words as numbers; hashes of the windows at the places `at` of the document (ascending), and the item's seeds (sorted) with their places."""
    lo, hi = np.searchsorted(seeds, hashes, "left"), np.searchsorted(seeds, hashes, "right")
    n = hi - lo
    bounds = np.cumsum(n)
    most = len(item) + 1
    done: list[np.ndarray] = []
    held = 0
    open_: dict[int, tuple[int, int]] = {}  # diagonal -> first place and seeds of a run that reaches the last place seen

    def close(runs: list[tuple[int, int, int]]) -> None:
        nonlocal held
        if runs:
            done.append(np.array(runs, dtype=np.int64).reshape(-1, 3))
            held += len(runs)
        if held > 8 * SLICE // 16:
            done[:] = [_first_few(np.concatenate(done), most, width)]
            held = len(done[0]) // 2  # what had to stay may grow again before the next look

    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(bounds, (bounds[begin - 1] if begin else 0) + SLICE, "right")))
        k = n[begin:end]
        d = np.repeat(at[begin:end], k)
        i = places[np.repeat(lo[begin:end] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
        same = np.ones(len(d), dtype=bool)
        for w in range(width):
            same &= doc[d + w] == item[i + w]
        d, i = d[same], i[same]
        order = np.lexsort((d, d - i))
        d, i = d[order], i[order]
        first = np.flatnonzero(np.append(True, (np.diff(d) != 1) | (np.diff(d - i) != 0))) if len(d) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(first, len(d)))
        last = at[end - 1] if end < len(at) else -2
        before, open_next, closed = int(at[begin - 1]) if begin else -2, {}, []
        for f, r in zip(first.tolist(), size.tolist(), strict=True):
            start, place, diagonal = int(d[f]), int(i[f]), int(d[f] - i[f])
            if start == before + 1 and (earlier := open_.pop(diagonal, None)):
                start, place, r = earlier[0], earlier[0] - diagonal, r + earlier[1]
            if start + r - 1 == last:
                open_next[diagonal] = (start, r)
            else:
                closed.append((start, place, r + width - 1))
        close(closed + [(s, s - g, r + width - 1) for g, (s, r) in open_.items()])
        open_, begin = open_next, end
    close([(s, s - g, r + width - 1) for g, (s, r) in open_.items()])
    if not done:
        return []
    return [tuple(x) for x in _first_few(np.concatenate(done), most, width).tolist()]


def _first_few(matches: np.ndarray, size: int, width: int) -> np.ndarray:
    """Of matches of the same item words, the earliest: tiles cover `size` words in all, so they overlap at most size + tiles * words of them."""
    order = np.lexsort((matches[:, 0], matches[:, 2], matches[:, 1]))
    m = matches[order]
    new = np.append(True, (np.diff(m[:, 1]) != 0) | (np.diff(m[:, 2]) != 0))
    nth = np.arange(len(m)) - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(m))))
    return m[nth <= size + (size // width + 1) * m[:, 2]]


@dataclass
class Index:
    """Seeds of a chunk of items."""

    match: int = MATCH
    vocab: dict[str, int] = field(default_factory=dict)
    ids: list = field(default_factory=list)  # item ids
    words: list[np.ndarray] = field(default_factory=list)  # words of each item, as numbers
    own: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # its seeds (sorted) and their places
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # by width: hashes (sorted), items, places

    @classmethod
    def build(cls, items: list[tuple[object, str | None]], match: int = MATCH) -> Index:
        index = cls(match)
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([index.vocab.setdefault(w, len(index.vocab) + 1) for w in words], dtype=np.uint64)
            h = window_hashes(ids, min(match, len(words)))
            order = np.argsort(h, kind="stable")
            found.setdefault(min(match, len(words)), []).append((h[order], len(index.ids)))
            index.ids.append(item)
            index.words.append(ids)
            index.own.append((h[order], order))
        for width, parts in found.items():
            h = np.concatenate([p for p, _ in parts])
            item = np.repeat([k for _, k in parts], [len(p) for p, _ in parts])
            order = np.argsort(h, kind="stable")
            index.seeds[width] = (h[order], item[order])
        return index

    def coverage(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, list[tuple[int, int, int]], float]]:
        """(item, tiles, coverage) for the items that cover threshold of their words in a text; items as places in ids."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        ids = np.fromiter((self.vocab.get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        out = []
        for width, (hashes, items) in self.seeds.items():
            h = window_hashes(ids, width)
            at = np.flatnonzero(h)
            if not len(at):
                continue
            met = np.unique(h[at])
            lo = np.searchsorted(hashes, met, "left")
            n = np.searchsorted(hashes, met, "right") - lo
            if not n.any():
                continue
            # Every seed of the index at most once. An item whose seeds that were met can't cover enough needs no tiling.
            who, seeds_met = np.unique(items[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], return_counts=True)
            known = at[np.isin(h[at], met[n > 0])]
            for k, m in zip(who.tolist(), seeds_met.tolist(), strict=True):
                size = len(self.words[k])
                if m * width < threshold * size:
                    continue
                tiles = tile(_runs(ids, self.words[k], h[known], known, *self.own[k], width), width)
                covered = sum(t[2] for t in tiles) / size
                if covered >= threshold:
                    out.append((k, tiles, covered))
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.length(F.trim("text")) > 0)


def _index(benchmark: DataFrame, match: int, chunk_chars: int) -> Broadcast | None:
    """The index of a benchmark, unless it has more than chunk_chars characters."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > chunk_chars:
        return None
    rows = sorted(((r.item_id, r.text) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return benchmark.sparkSession.sparkContext.broadcast(Index.build(rows, match))


def _matches_type(docs: DataFrame, benchmark: DataFrame) -> T.StructType:
    tile_type = T.StructType([T.StructField(n, T.IntegerType()) for n in ("doc_word", "item_word", "words")])
    plain = [("coverage", T.DoubleType()), ("n_tiles", T.IntegerType()), ("longest", T.IntegerType()), ("first_word", T.IntegerType()), ("tiles", T.ArrayType(tile_type))]
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType), *(T.StructField(n, t) for n, t in plain)])


def _batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows (doc, item, coverage, tiles)."""
    rows = [(d, i, c, len(t), max(x[2] for x in t), min(x[0] for x in t), [dict(zip(("doc_word", "item_word", "words"), x, strict=True)) for x in sorted(t)]) for d, i, c, t in out]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, match: int = MATCH, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """A row for each document and item that it contaminates: doc_id, item_id, coverage, n_tiles, longest, first_word, tiles."""
    kind = _matches_type(docs, benchmark)
    schema = to_arrow_schema(kind)
    index = _index(benchmark, match, chunk_chars)
    if index is None:
        met = _candidates(docs, benchmark, threshold, match)

        def work_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc, item, text, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    out += [(doc, item, c, tiles) for _, tiles, c in Index.build([(item, words.as_py())], match).coverage(text.as_py(), threshold)]
                yield _batch(out, schema)

        return met.select("doc_id", "item_id", "doc_text", "item_text").mapInArrow(work_pairs, kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for batch in batches:
            yield _batch([(doc, own.ids[k], c, tiles) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for k, tiles, c in own.coverage(text.as_py(), threshold)], schema)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, kind)


def word_hashes(words: list[str]) -> np.ndarray:
    """Numbers of words that don't depend on a vocabulary; never 0."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w.encode()) | 1 for w in words), dtype=np.uint64, count=len(words))


def _seeds(rows: DataFrame, widths: list[int], items: bool, match: int) -> DataFrame:
    """(key, seed, n, size) from (key, text): distinct seeds with their number of places and the text's words; of an item only those of its own width."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = word_hashes(words_of(text.as_py()))
                for width in [min(match, len(ids))] if items else widths:
                    h = window_hashes(ids, width) if width else ids
                    seed, n = np.unique(h * np.uint64(2 * width + 1), return_counts=True)  # seeds of different widths don't meet
                    for at in range(0, len(seed), 20_000):
                        s = seed[at : at + 20_000]
                        yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(s), pa.int64()), pa.array(s.view(np.int64)), pa.array(n[at : at + 20_000]), pa.array(np.full(len(s), len(ids)))], ["key", "seed", "n", "size"])

    return rows.select("key", "text").mapInArrow(work, "key long, seed long, n long, size long")


def _candidates(docs: DataFrame, benchmark: DataFrame, threshold: float, match: int) -> DataFrame:
    """doc_id, item_id, doc_text, item_text, doc_key of all pairs that may be a contamination, by joins on seeds.

    Keys are hashes of id and text, so equal rows share one; a collision of others adds a pair that tiling then refuses."""
    key = F.xxhash64(F.col("id").cast("string"), "text")
    named = lambda df, name: df.select(F.col(name).alias("id"), F.col("text").cast("string").alias("text")).withColumn("key", key)
    texts, items = named(docs, "doc_id"), named(_items(benchmark), "item_id")
    seeds = materialize(_seeds(items.dropDuplicates(["key"]), [], True, match), "seeds").withColumn("width", F.least("size", F.lit(match)))
    widths = [r.width for r in seeds.select("width").distinct().collect()]  # 1 to match
    # Seeds of documents that some item may have: by a table of bits.
    word, bit = F.pmod(F.xxhash64("seed"), F.lit(BIT_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("seed", F.lit(1)), F.lit(64)).cast("int"))
    bits = seeds.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    some = _seeds(texts, widths, False, match).select("key", "seed").withColumn("word", word).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0).select("key", "seed")
    met = materialize(some.join(seeds.select("seed").distinct(), "seed", "left_semi").distinct(), "met")
    # A document must meet `need` seeds of an item, so it meets one of the rarest (all - need + 1), counted by places.
    often = met.groupBy("seed").agg(F.count(F.lit(1)).alias("often"))
    need = F.ceil(F.lit(threshold) * F.col("size") / F.col("width"))
    rank = F.sum("n").over(Window.partitionBy("key").orderBy("often", "seed").rowsBetween(Window.unboundedPreceding, -1))
    rare = seeds.join(often, "seed").withColumn("before", F.coalesce(rank, F.lit(0)))
    total = seeds.groupBy("key").agg(F.sum("n").alias("places"))
    posted = rare.join(total, "key").where(F.col("before") <= F.col("places") - need).select(F.col("key").alias("item_key"), "seed")
    pairs = met.withColumnRenamed("key", "doc_key").join(posted, "seed").select("doc_key", "item_key").distinct()
    held = texts.select(F.col("id").alias("doc_id"), F.col("key").alias("doc_key"), F.col("text").alias("doc_text"))
    asked = items.select(F.col("id").alias("item_id"), F.col("key").alias("item_key"), F.col("text").alias("item_text"))
    return held.join(pairs, "doc_key").join(asked, "item_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, match: int = MATCH, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The rows of docs that no item contaminates, all columns kept; nothing is shuffled unless the benchmark has to be joined."""
    at = docs.columns.index("text")
    index = _index(benchmark, match, chunk_chars)
    if index is None:
        found = find_contamination(docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("doc_id", F.xxhash64(F.col("doc_id").cast("string"), "text")), benchmark, threshold, match, chunk_chars)
        mark = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))
        bad = found.select(F.col("doc_id").alias("bad")).distinct()
        return docs.join(bad, mark == F.col("bad"), "left_anti")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for batch in batches:
            yield batch.filter(pa.array([not own.coverage(t.as_py(), threshold) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(work, T.StructType(docs.schema.fields))
