"""9. Token counts: pieces counted once per distinct pre-token, joined to per-document frequencies, summed.

1. Documents are cut into pre-tokens in blocks (the documents of a task, up to fixed numbers of documents and
   tokens). For each distinct pre-token of a block one row comes out: its postings, that is place in the
   block and frequency for each of the block's documents that has it, packed into bytes.
2. The distinct pre-tokens (partial and final aggregation over the vocabularies of blocks) get their number
   of pieces from the tokenizer's model, once each.
3. Postings join the numbers on the pre-token. A frequent pre-token has one row a block, however many documents
   hold it, and both sides of the join are dealt by hash, so adaptive execution splits what is still uneven.
4. Each task adds up what its rows give to each document of a block, and the sums meet by block, with the
   keys and sizes of the block's documents, which travel along as a posting of the empty pre-token.

No document gets ids; those of a distinct pre-token exist for the moment in which they are counted. Null and empty texts count 0. Repeated rows and null keys are rows of their own,
as a row is known by its place in its block. Special strings inside a text count 1 each, as the library's default has it. A very long text is a block of its own, whose
frequencies go into several postings; a very long pre-token is counted like any other. Other columns, whatever their names, don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huespan.llm.pretokens import Cutter

#: Most documents and tokens of a block; a single document may have more tokens.
BLOCK_DOCS, BLOCK_TOKENS = 8192, 4_000_000
#: Bytes of sums that a task holds before it passes them on.
SUMS_BYTES = 64 << 20

_cutters: dict[str, Cutter] = {}
POSTING = np.dtype([("doc", "<u2"), ("n", "u1")])
#: Largest frequency of a posting.
MOST = 255
HEADER = np.dtype([("known", "?"), ("key", "<i8"), ("n_bytes", "<i8")])
SUM = np.dtype([("doc", "<u2"), ("n", "<u4")])


def cutter(path: str) -> Cutter:
    if path not in _cutters:
        _cutters[path] = Cutter(path, words=True)
    return _cutters[path]


def _cut_block(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list[str], list[np.ndarray], list[tuple]]]:
    """For each block: vocabulary, each document's pre-tokens as places in it, and each document's (key, bytes)."""
    c = cutter(path)
    vocab: dict[str, int] = defaultdict(count().__next__)
    docs: list[np.ndarray] = []
    heads: list[tuple] = []
    held = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = text.as_py() or ""
            places: list[int] = []
            for part, special in c.parts(t):
                places += [vocab[part]] if special else [vocab[p] for p in c.cut(part)]
            docs.append(np.array(places, dtype=np.int32))
            heads.append((key is not None, key or 0, len(t.encode("utf-8", "surrogatepass"))))
            held += len(places)
            if len(docs) >= BLOCK_DOCS or held >= BLOCK_TOKENS:
                yield list(vocab), docs, heads
                vocab, docs, heads, held = defaultdict(count().__next__), [], [], 0
    if docs:
        yield list(vocab), docs, heads


def _postings(docs: DataFrame, path: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, (vocab, rows, heads) in enumerate(_cut_block(batches, path)):
            block = part << 24 | k
            # Sorted pairs (place in vocabulary, document) with their frequencies.
            sizes = [len(r) for r in rows]
            pair = np.concatenate(rows).astype(np.int64) << 16 | np.repeat(np.arange(len(rows)), sizes)
            rows.clear()
            pair, n = np.unique(pair, return_counts=True)
            times = -(-n // MOST)  # a frequency that a byte doesn't hold goes into several postings
            if times.size and times.max() > 1:
                last = np.cumsum(times) - 1
                pair, rest = np.repeat(pair, times), n - MOST * (times - 1)
                n = np.full(len(pair), MOST)
                n[last] = rest
            packed = np.empty(len(pair), dtype=POSTING)
            packed["doc"], packed["n"] = pair & 0xFFFF, n
            ends = np.searchsorted(pair >> 16, np.arange(len(vocab) + 1)).astype(np.int64) * POSTING.itemsize
            head = np.array(heads, dtype=HEADER).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([""]), pa.array([head], pa.binary())], ["block", "pretoken", "postings"])
            for at in range(0, len(vocab), 20_000):
                words, e = vocab[at : at + 20_000], ends[at : at + 20_001]
                data = packed.view(np.uint8)[e[0] : e[-1]]
                lists = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer((e - e[0]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block), pa.int64()), pa.array(words, pa.string()), lists], ["block", "pretoken", "postings"])

    return docs.mapInArrow(work, "block long, pretoken string, postings binary")


def _vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """Distinct pre-tokens of all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cutter(path)
        seen: set[str] = set()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.string())], ["pretoken"])
            seen.clear()

        for batch in batches:
            for text in batch.column(1):
                for part, special in c.parts(text.as_py() or ""):
                    seen.update([part] if special else c.cut(part))
            if len(seen) > 500_000:
                yield from out()
        yield from out()

    return docs.mapInArrow(work, "pretoken string").distinct()


def count_pieces(pretokens: DataFrame, path: str) -> DataFrame:
    """Adds n_pieces to distinct pre-tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = cutter(path).library
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                words = batch.column(0).slice(at, 2000)
                found = lib.encode_batch_fast(words.to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([words, pa.array([len(x.ids) for x in found], pa.int32())], ["pretoken", "n_pieces"])

    return pretokens.select("pretoken").mapInArrow(work, "pretoken string, n_pieces int")


def _sums(joined: DataFrame) -> DataFrame:
    """Rows (block, postings, n_pieces) to a few rows for each block and task: its header, or sums by document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            blocks, data = [], []
            for block, parts in sums.items():
                total = np.bincount(np.concatenate([p["doc"] for p in parts]), weights=np.concatenate([p["n"] for p in parts])).astype(np.int64)
                at = np.flatnonzero(total)
                packed = np.empty(len(at), dtype=SUM)
                packed["doc"], packed["n"] = at, total[at]
                blocks.append(block)
                data.append(packed.tobytes())
            sums.clear()
            for k in range(0, len(blocks), 500):
                yield pa.RecordBatch.from_arrays([pa.array(blocks[k : k + 500], pa.int64()), pa.array([False] * len(blocks[k : k + 500])), pa.array(data[k : k + 500], pa.binary())], ["block", "head", "data"])

        for batch in batches:
            heads = []
            for block, data, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = data.as_buffer()
                if n is None:
                    heads.append((block, data.as_py()))
                    continue
                p = np.frombuffer(raw, dtype=POSTING)
                s = np.empty(len(p), dtype=SUM)
                s["doc"], s["n"] = p["doc"], p["n"].astype(np.uint32) * n
                mine = sums.setdefault(block, [])
                mine.append(s)
                held += s.nbytes
            if heads:
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in heads], pa.int64()), pa.array([True] * len(heads)), pa.array([h[1] for h in heads], pa.binary())], ["block", "head", "data"])
            if held > SUMS_BYTES:
                yield from out()
                held = 0
        yield from out()

    return joined.mapInArrow(work, "block long, head boolean, data binary")


def token_counts(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: key, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    pieces = count_pieces(_vocabulary(rows, path), path)
    joined = _postings(rows, path).hint("merge").join(pieces, "pretoken", "left").select("block", "postings", "n_pieces")

    def meet(table: pa.Table) -> pa.Table:
        heads, data = table.column("head").to_pylist(), table.column("data").to_pylist()
        head = np.frombuffer(next(d for h, d in zip(heads, data, strict=True) if h), dtype=HEADER)
        total = np.zeros(len(head), dtype=np.int64)
        for h, d in zip(heads, data, strict=True):
            if not h:
                s = np.frombuffer(d, dtype=SUM)
                total[s["doc"]] += s["n"]
        return pa.table({"key": pa.array(head["key"], mask=~head["known"]), "n_bytes": pa.array(head["n_bytes"]), "n_tokens": pa.array(total)})

    met = _sums(joined).groupBy("block").applyInArrow(meet, "key long, n_bytes long, n_tokens long")
    return met.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
