"""10. BPE encoding and decoding with a backtracking encoder and an offset table.

An Aho-Corasick automaton over all vocabulary entries finds, for every position of a pre-token,
the entries that start there. The encoder takes the longest one that is compatible with its left
neighbour, steps to shorter ones if it is not, and steps back over the neighbour if none is left;
a position found dead is never tried again, so each is left at most once per entry that starts there.
Two neighbours are compatible if no merge across their border would have been done before the
merges that built them; with that, exactly one sequence of entries is free of conflicts, and it is
the one that the merge loop gives.

Decoding gathers bytes from one blob of all entries through a table of their offsets.

Null, empty: no ids. Repeated rows, null keys: results of their own. Very long pre-tokens: linear, and cached like others until the cache is cleared, as it is
before the next text once it holds CACHE_IDS ids. Columns named as a result are replaced; others, whatever their names, are kept. An empty table gives an empty one.
No ties arise: the sequence of entries is unique. Executors hold the vocabulary and that cache, besides the text in hand; rows never meet.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huespan.llm.common import unused
from huespan.llm.pretokens import Cutter, byte_alphabet

#: Pre-tokens, and ids of theirs, that a worker keeps from one text to the next.
CACHE_ENTRIES, CACHE_IDS = 500_000, 1 << 22
#: Pairs of entries whose compatibility a worker remembers.
MOST_PAIRS = 1_000_000


class BacktrackingBpe:
    """Exact byte-level BPE for a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, alphabet = model["vocab"], byte_alphabet()
        # An entry's rank: its byte, or 256 and the place of its merge.
        rank_of = {c: b for c, b in alphabet.items()}
        entries = [bytes([b]) for b in range(256)]
        by_byte = {b: c for c, b in alphabet.items()}
        ids = [vocab[by_byte[b]] for b in range(256)]
        self.left, self.right = list(range(256)), list(range(256))
        self.merged: dict[int, int] = {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, r = rank_of[a], rank_of[b], len(entries)
            rank_of[a + b] = r
            entries.append(entries[x] + entries[y])
            ids.append(vocab[a + b])
            self.left.append(x)
            self.right.append(y)
            self.merged[x << 32 | y] = r
        self.size, self.ids = [len(e) for e in entries], ids
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        reached = [True] * 256
        for r in range(256, len(entries)):
            x, y = self.left[r], self.right[r]
            reached.append(reached[x] and reached[y] and self.compatible(x, y, r))
        for r, e in enumerate(entries):
            if reached[r]:  # an entry that its own bytes don't lead to is never used
                self.automaton.add_word(e.decode("latin-1"), (r, len(e)))
        self.automaton.make_automaton()
        # Offset table by id, for decoding.
        length = np.zeros(max(ids) + 1, dtype=np.int64)
        length[ids] = self.size
        self.offset = np.concatenate([[0], np.cumsum(length)])
        blob = np.zeros(int(self.offset[-1]), dtype=np.uint8)
        for i, e in zip(ids, entries, strict=True):
            blob[self.offset[i] : self.offset[i] + len(e)] = np.frombuffer(e, dtype=np.uint8)
        self.blob = blob

    def compatible(self, a: int, b: int, limit: int = 1 << 62) -> bool:
        """Whether entries a, b can stand side by side: no merge of ranks below limit joins their inner borders in time."""
        merged, left, right = self.merged, self.left, self.right
        while True:
            m = merged.get(a << 32 | b)
            if m is not None and m < limit:
                return False
            if a > b:  # a was built later: look at the border as it was before that
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        text = piece.decode("latin-1")
        whole = self.automaton.get(text, None)
        if whole is not None:  # the longest match at its start, with nothing to be compatible with
            return [self.ids[whole[0]]]
        n, size, pairs = len(text), self.size, self.pairs
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, (r, length) in self.automaton.iter(text):
            starts[end + 1 - length].append(r)  # ends ascend, so lengths do
        out: list[int] = []
        tries: list[int] = []  # which entry was taken at each start
        dead, at = bytearray(n + 1), 0
        k = len(starts[0]) - 1 if n else 0
        while at < n:
            here = starts[at]
            if out:
                before = out[-1]
                while k >= 0:
                    r = here[k]
                    if not dead[at + size[r]]:
                        key = before << 32 | r
                        fits = pairs.get(key)
                        if fits is None:
                            fits = self.compatible(before, r)
                            if len(pairs) < MOST_PAIRS:
                                pairs[key] = fits
                        if fits:
                            break
                    k -= 1
            else:
                while k >= 0 and dead[at + size[here[k]]]:
                    k -= 1
            if k >= 0:
                out.append(here[k])
                tries.append(k)
                at += size[here[k]]
                if at < n:
                    k = len(starts[at]) - 1
            else:
                dead[at] = 1
                at -= size[out.pop()]
                k = tries.pop() - 1
        return [self.ids[r] for r in out]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        if not len(ids):
            return b""
        start, n = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        before = np.cumsum(n) - n
        return self.blob[np.repeat(start - before, n) + np.arange(int(n.sum()))].tobytes()


class Codec:
    """Text to ids and back, with special strings as the library's default has them.

    The ids of cached pre-tokens stand one after the other in one array; a pre-token is known by its number there,
    and a text's ids are gathered by the numbers of its pre-tokens.
    """

    def __init__(self, path: str):
        self.bpe, self.cutter = BacktrackingBpe(path), Cutter(path, words=False)
        self.special_text = {i: s.encode() for s, i in self.cutter.special.items()}
        self._grow()
        self._clear()

    def _grow(self) -> None:
        """Special strings that the vocabulary lacks go to the end of the offset table."""
        b = self.bpe
        for i in sorted(self.special_text):
            while len(b.offset) < i + 2:
                b.offset = np.append(b.offset, b.offset[-1])
            if b.offset[i + 1] == b.offset[i]:
                b.blob = np.concatenate([b.blob[: b.offset[i]], np.frombuffer(self.special_text[i], dtype=np.uint8), b.blob[b.offset[i] :]])
                b.offset[i + 1 :] += len(self.special_text[i])

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []  # decimal ids, comma-joined
        self.flat = np.zeros(1 << 16, dtype=np.int64)
        self.start = np.zeros(1 << 16, dtype=np.int64)  # one more than there are numbers

    def _add(self, piece: str, special: bool = False) -> int:
        ids = [self.cutter.special[piece]] if special else self.bpe.encode_piece(piece.encode("utf-8"))
        k = len(self.text)
        if k + 2 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        at = self.start[k]
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[at : at + len(ids)] = ids
        self.start[k + 1] = at + len(ids)
        self.text.append(",".join(map(str, ids)))
        if not special:
            self.number[piece] = k
        return k

    def numbers(self, text: str) -> list[int]:
        """The numbers of a text's pre-tokens, which hold until the next call."""
        if len(self.text) > CACHE_ENTRIES or len(self.flat) > CACHE_IDS:
            self._clear()
        out: list[int] = []
        for part, special in self.cutter.parts(text):
            if special:
                out.append(self._add(part, True))
                continue
            pieces = self.cutter.cut(part)
            known = [*map(self.number.get, pieces)]
            if None in known:
                for k, x in enumerate(known):
                    if x is None:
                        x = self.number.get(pieces[k])
                        known[k] = self._add(pieces[k]) if x is None else x
            out += known
        return out

    def gather(self, numbers: list[int]) -> np.ndarray:
        """Ids of pre-tokens by their numbers."""
        k = np.array(numbers, dtype=np.int64)
        start = self.start[k]
        n = self.start[k + 1] - start
        if not len(k):
            return k
        before = np.cumsum(n) - n
        return self.flat[np.repeat(start - before, n) + np.arange(int(n.sum()))]

    def encode(self, text: str) -> np.ndarray:
        return self.gather(self.numbers(text))

    def decode(self, ids: np.ndarray) -> str:
        return self.bpe.decode(ids).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all but the text by default) and `ids`, an array of ints for every row."""
    keep = [c for c in docs.columns if c not in (text, ids)] if keep is None else keep
    out = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias(unused(docs, "encoded")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = [c.encode(t or "") for t in batch.column(len(keep)).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*keep, ids])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1]), f"`{ids}` array<int>"])
    return out.mapInArrow(work, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The other way: `ids` becomes `text`; null ids decode to an empty text."""
    keep = [c for c in encoded.columns if c not in (text, ids)]
    out = encoded.select(*[encoded[c] for c in keep], encoded[ids].alias(unused(encoded, "decoded")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = [c.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, pa.string())], [*keep, text])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1]), f"`{text}` string"])
    return out.mapInArrow(work, schema)


def round_trip_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_tokens, and SHA-256 of its ids (decimal, comma-joined) and of the text decoded from them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1).to_pylist():
                numbers = c.numbers(t or "")
                ids = c.gather(numbers)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(c.text.__getitem__, numbers)).encode()).hexdigest())
                b.append(hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(work, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
