"""9 and 10: exact against the tokenizers library, on odd texts and on a whole table."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from huespan.llm import bpe, queries, token_counts
from huespan.llm.pretokens import Cutter

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "e", "th", " ", "  ", "\n", "'s", "'", "1", "²", "½", "é", "É", "ñ", "中", "文", "🙂", "<|endoftext|>", "<|startoftext|>", "<|", "_", "\x1c", "\x85", "　", "İ", "ing", "the", "ABC", "==", "\t", "...", " the", "́", "ß", "Σ", "ǅ", "Ə", "Ɓ", "Ɛ", "Ɔ", "Ⱥ", "K", "ẞ"]


def texts(rnd, n=3000):
    return ["", *("".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n))]


def test_encoder_is_exact_and_round_trips(rnd):
    codec, lib = bpe.codec(BYTES), Tokenizer.from_file(BYTES)
    for t in texts(rnd):
        want = lib.encode(t, add_special_tokens=False).ids
        got = codec.encode(t)
        assert got.tolist() == want, t
        assert codec.decode(got) == lib.decode(want, skip_special_tokens=False) == t


@pytest.mark.parametrize("text", ["a" * 50_000, "abcdeinth" * 5000, " " * 20_000, "é" * 10_000])
def test_long_pretokens(text):
    assert bpe.codec(BYTES).encode(text).tolist() == Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids


def test_every_entry_that_its_bytes_lead_to_is_one_id():
    codec, lib = bpe.codec(BYTES), Tokenizer.from_file(BYTES)
    some = [lib.decode([i]) for i in range(300, 50_000, 7)]
    for t in some:
        if "�" not in t:
            assert codec.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_cache_may_be_cleared_between_texts(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    codec, lib = bpe.Codec(BYTES), Tokenizer.from_file(BYTES)
    for t in ["one two three four five six", "seven eight nine", "one two three"]:
        assert codec.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_frames_keep_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 1), (None, None, None, 2), (3, "", "y", 3)], "doc_id long, text string, ids string, n_tokens int")
    back = bpe.decode(bpe.encode(docs, BYTES), BYTES)
    assert sorted(map(str, back.select("doc_id", "n_tokens", "text").collect())) == sorted(map(str, docs.select("doc_id", "n_tokens", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert bpe.encode(docs.limit(0), BYTES).count() == 0


def test_digests_of_a_whole_table(spark, small):
    rows = {r.doc_id: r for r in queries.op10_bpe(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    lib = Tokenizer.from_file(BYTES)
    assert len(rows) == len(docs)
    for d in docs:
        ids = lib.encode(d.text, add_special_tokens=False).ids
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_pretokens_of_plain_and_other_text_agree(rnd):
    cutter = Cutter(BYTES, words=False)
    for t in texts(rnd, 500):
        t = "".join(c for c in t if ord(c) < 0x250)
        chars = cutter.chars
        assert cutter.cut(t) == [bytes(chars[c] for c in p).decode() for p, _ in cutter.library.pre_tokenizer.pre_tokenize_str(t)]


def low_characters():
    return [chr(k) for k in range(0x250)] + [c for c in map(chr, range(0x250, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and any(ord(x) < 0x250 for x in c.lower())]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_cuts_of_all_low_characters_and_pairs_give_the_library_s_pieces(path, rnd):
    lib, cutter = Tokenizer.from_file(path), Cutter(path, words=path == WORDS)
    low = low_characters()
    texts = [*low, *(f"{a}{b}" for a in low for b in rnd.sample(low, 60)), *(f"{rnd.choice(low)}{a}{b} {c}" for a, b, c in (rnd.choices(low, k=3) for _ in range(10_000)))]

    def pieces(text):
        if lib.normalizer is not None:
            text = lib.normalizer.normalize_str(text)
        return [p for p, _ in lib.pre_tokenizer.pre_tokenize_str(text)]

    shown = {b: c for c, b in cutter.chars.items()}
    for t in texts:
        assert ["".join(shown[b] for b in p.encode()) for p in cutter.cut(t)] == pieces(t), ascii(t)


@pytest.mark.parametrize("text", ["AZ\u018fRBAYCAN", "\u011e\u0193", "\u0186\u0189\u0190\u0194 \u023a", "\u212a\u212b", "\u0130stanbul"])
def test_capitals_whose_small_letters_lie_elsewhere(text):
    cutter, lib = token_counts.cutter(WORDS), Tokenizer.from_file(WORDS)
    assert sum(len(x.ids) for x in lib.encode_batch(cutter.cut(text), add_special_tokens=False)) == len(lib.encode(text, add_special_tokens=False).ids)


def counted(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, WORDS).collect())


def expected(rows):
    lib = Tokenizer.from_file(WORDS)
    out = []
    for k, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        out.append((-1 if k is None else k, len((t or "").encode()), n, n > 2048))
    return sorted(out)


def test_counts_are_exact(spark, rnd):
    rows = [*enumerate(texts(rnd, 800)), (None, "a b"), (None, None), (5, "again"), (5, "again"), (9000, "word " * 70_000), (9001, "x" * 3000)]
    assert counted(spark, rows) == expected(rows)


def test_counts_in_small_blocks(spark, rnd, monkeypatch):
    rows = list(enumerate(texts(rnd, 200)))
    block = next(iter([token_counts._cut_block]))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], ["key", "text"])
    monkeypatch.setattr(token_counts, "BLOCK_DOCS", 7)
    blocks = list(block(iter([batch]), WORDS))
    assert len(blocks) == -(-len(rows) // 7) and sum(len(b[1]) for b in blocks) == len(rows)


def test_counts_of_an_empty_table(spark):
    assert counted(spark, []) == []


def test_counts_of_a_whole_table(spark, small):
    got = {r.doc_id: r.n_tokens for r in queries.op9_token_counts(spark, small).collect()}
    lib = Tokenizer.from_file(WORDS)
    for d in spark.read.parquet(f"{small}/documents.parquet").collect():
        assert got[d.doc_id] == len(lib.encode(d.text, add_special_tokens=False).ids)


def test_offset_table_decodes_any_ids():
    codec = bpe.codec(BYTES)
    lib = Tokenizer.from_file(BYTES)
    ids = [50256, 0, 198, 50255, 220, 50256]
    assert codec.decode(np.array(ids)) == lib.decode(ids, skip_special_tokens=False)
