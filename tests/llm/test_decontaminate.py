"""5: tiles against a plain greedy tiling, and planted passages."""

import tracemalloc

import pytest
from pyspark.sql import functions as F

from huespan.llm import decontaminate, queries
from huespan.llm.decontaminate import Index, drop_contaminated, find_contamination, tile, words_of


def plain_tiles(doc, item, least):
    """The published algorithm, word by word."""
    in_doc, in_item, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in in_doc and i + n not in in_item:
                    n += 1
                if n >= least and (best is None or (-n, d, i) < best):
                    best = (-n, d, i)
        if best is None:
            return sorted(tiles)
        n, d, i = -best[0], best[1], best[2]
        tiles.append((d, i, n))
        in_doc.update(range(d, d + n))
        in_item.update(range(i, i + n))


@pytest.mark.parametrize("pairs", [1 << 19, 3])
def test_tiles_equal_plain_tiling(rnd, monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "SLICE", pairs)
    for _ in range(300):
        words = [f"w{k}" for k in range(rnd.choice([2, 4, 12]))]
        doc, item = [rnd.choice(words) for _ in range(rnd.randint(0, 40))], [rnd.choice(words) for _ in range(rnd.randint(4, 20))]
        if rnd.random() < 0.7 and len(doc) > 5:
            k = rnd.randint(0, len(doc) - 4)
            item[2:6] = doc[k : k + 4]
        index = Index.build([(1, " ".join(item))])
        found = index.coverage(" ".join(doc), threshold=0.0)
        assert sorted(found[0][1] if found else []) == plain_tiles(doc, item, 4)


def test_tile_cuts_what_is_covered():
    assert tile([(0, 0, 10), (8, 8, 6), (20, 2, 5)], 4) == [(0, 0, 10), (10, 10, 4)]


def frames(spark):
    item = " ".join(f"q{k}" for k in range(30))
    w = item.split()
    docs = [
        (1, f"before it {item} and after"),
        (2, " ".join(["x"] * 5 + w[20:30] + ["y"] * 9 + w[0:10] + ["z"] + w[10:20])),  # reordered
        (3, " ".join(w[:10] + ["x"] * 50)),  # a third of it
        (4, "nothing of the kind"),
        (5, None),
        (6, ""),
        (7, "SHORT, one!"),
        (None, item),
        (1, f"before it {item} and after"),
        (8, " ".join(v for k in range(30) for v in (w[k], "gap"))),  # all words, no run
    ]
    bench = [(10, item), (11, "short one"), (12, None), (13, ""), (10, item)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")


def test_planted_cases(spark):
    docs, bench = frames(spark)
    got = {(r.doc_id, r.item_id) for r in find_contamination(docs, bench).collect()}
    assert got == {(1, 10), (2, 10), (None, 10), (7, 11)}
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8]
    assert find_contamination(docs, bench.limit(0)).count() == 0 and drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert find_contamination(docs.limit(0), bench).count() == 0


def test_chunks_make_no_difference(spark):
    docs, bench = frames(spark)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(find_contamination(docs, bench, chunk_chars=20)) == rows(find_contamination(docs, bench))


def test_memory_is_bounded_where_texts_repeat_themselves():
    index = Index.build([(k, " ".join(["same"] * 200)) for k in range(20)])
    tracemalloc.start()
    found = index.coverage(" ".join(["same"] * 20_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(k, tiles) for k, tiles, _ in found] == [(k, [(0, 0, 200)]) for k in range(20)]
    assert peak < 300e6


def test_hash_hits_are_checked_by_words(monkeypatch):
    monkeypatch.setattr(decontaminate, "window_hashes", lambda ids, width: decontaminate.np.ones(max(0, len(ids) - width + 1), dtype=decontaminate.np.uint64))
    index = Index.build([(1, "a b c d e f g h")])
    assert index.coverage("h g f e d c b a") == []
    assert index.coverage("x a b c d e y")[0][1] == [(1, 0, 5)]


@pytest.mark.parametrize("chunk_chars", [16_000_000, 20])
def test_other_ids_and_clashing_columns(spark, chunk_chars):
    docs, bench = frames(spark)
    docs = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).withColumns({"item_id": F.lit(1), "coverage": F.lit("x"), "key": F.lit(2)})
    bench = bench.withColumn("item_id", F.concat(F.lit("i"), F.col("item_id").cast("string"))).withColumn("doc_id", F.lit(3))
    got = {(r.doc_id, r.item_id) for r in find_contamination(docs, bench, chunk_chars=chunk_chars).collect()}
    assert got == {("d1", "i10"), ("d2", "i10"), (None, "i10"), ("d7", "i11")}
    kept = drop_contaminated(docs, bench, chunk_chars=chunk_chars)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == ["d3", "d4", "d5", "d6", "d8"]


def test_joined_benchmark_equals_indexed_one(spark, rnd):
    words = [f"w{k}" for k in range(40)]
    bench = [(k, " ".join(rnd.choice(words[: rnd.choice([3, 40])]) for _ in range(rnd.randint(1, 30)))) for k in range(60)]
    docs = []
    for k in range(120):
        parts = [rnd.choice(bench)[1].split() for _ in range(rnd.randint(0, 3))]
        docs.append((k, " ".join(w for p in parts for w in [*p[rnd.randint(0, 6) :], *rnd.choices(words, k=5)])))
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(find_contamination(docs, bench, chunk_chars=20)) == rows(find_contamination(docs, bench)) != []
    assert rows(drop_contaminated(docs, bench, chunk_chars=20)) == rows(drop_contaminated(docs, bench))


def test_whole_table_against_containment(spark, sf):
    bench = [f" {' '.join(words_of(r.text))} " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if any(b in f" {' '.join(words_of(r.text))} " for b in bench)}
    assert {r.doc_id for r in queries.op5_decontamination(spark, sf).collect()} == holds
