"""3: components equal those of all pairs, compared by brute force."""

from collections import Counter, defaultdict

import pytest

from huespan.llm import near_dedup
from huespan.llm.components import components
from huespan.llm.near_dedup import keep_one_of_each, near_duplicates


def reference_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    sets, holders = [reference_set(t) for _, t in rows], defaultdict(list)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for h in s for j in holders[h]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for h in s:
            holders[h].append(i)
    texts = [find(i) for i in range(len(rows))]  # groups by texts alone
    by_id = {}
    for i, (d, _) in enumerate(rows):
        parent[find(i)] = find(by_id.setdefault(d, i))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), texts


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())


def families(rnd):
    vocab = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(3, 300))]
        for _ in range(rnd.choice([1, 2, 5, 30])):
            p = rnd.choice([0, 0.01, 0.03, 0.05])
            rows.append((len(rows), " ".join(w if rnd.random() > p else f"e{rnd.randint(0, 999)}" for w in base)))
    passage = [rnd.choice(vocab) for _ in range(80)]
    for _ in range(150):  # a passage that many share, in documents that are mostly it or mostly not
        rows.append((len(rows), " ".join([rnd.choice(vocab) for _ in range(rnd.randint(0, 60))] + passage + [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))])))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " \n", "a", "A", "b c", "B  c", "a b c d e", "é x", "É x"])]
    return rows


@pytest.mark.parametrize("block", [512, 10])
def test_components_of_families(spark, rnd, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    if block == 10:
        monkeypatch.setattr(near_dedup, "CROSS", 4)
        monkeypatch.setattr(near_dedup, "CELL", 1)
        monkeypatch.setattr(near_dedup, "LEADERS", 2)
    rows = families(rnd)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)[0]


def changed(rnd, base, n):
    out = list(base)
    for k in rnd.sample(range(len(out)), n):
        out[k] = f"x{rnd.randint(0, 10**9)}"
    return " ".join(out)


def test_repeated_ids_with_other_texts(spark, rnd):
    a, b, c = ([f"{x}{k}" for k in range(120)] for x in "abc")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, changed(rnd, b, 2)), (11, changed(rnd, a, 2)), (5, " ".join(a)), (20, ""), (20, ""), (20, " ".join(c)), (4, changed(rnd, c, 2)), (30, " ".join(f"d{k}" for k in range(9)))]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, near int")
    want, texts = brute(rows)
    assert result(df) == want
    assert {r[0]: r[2] for r in want} == {4: 4, 5: 5, 9: 5, 11: 5, 20: 4, 30: 30}
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    # One row of each group of linked texts: the other text of a repeated id isn't lost.
    assert sorted((r.doc_id, (r.text or "")[:2]) for r in kept.collect()) == [(4, "c0"), (5, "a0"), (5, "b0"), (20, ""), (30, "d0")]


def test_a_family_below_the_threshold_loses_no_link(spark, rnd, monkeypatch):
    """Similarities of 0.66 to 0.8: some linked, most not, all in the same posting lists."""
    for name in ("CROSS", "CELL"):
        monkeypatch.setattr(near_dedup, name, 8)
    base = [f"w{k}" for k in range(400)]
    rows = [(k, changed(rnd, base, rnd.choice([5, 6, 8, 8, 8]))) for k in range(250)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)[0]


def test_similar_agrees_with_plain_sets(rnd):
    import numpy as np

    sets = [np.unique(np.array([rnd.randint(0, 40) for _ in range(rnd.randint(1, 60))], dtype=np.uint64)) for _ in range(30)]
    every = [(x, y) for x in range(30) for y in range(30) if x != y]
    for pairs in (every, every[:20], every[::7]):
        a, b = np.array(pairs).T
        plain = [100 * len(set(sets[x]) & set(sets[y])) >= 75 * len(set(sets[x]) | set(sets[y])) for x, y in pairs]
        assert near_dedup._similar(sets, a, b).tolist() == plain


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])[0]


def test_null_ids_repeats_extra_columns_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "a b c d e f", 2), (1, "A b c d e  f", 3)], "doc_id long, text string, component_id int")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [("1", 2, 1, True), ("2", 2, 1, False), ("2", 2, 1, False), ("None", 2, None, False)]
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark, rnd):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (202, 202)]
    rnd.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
