import random
import re

import numpy as np
import pytest
import xxhash

from gridspan.llm import simhash_vptree as s


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """doc_id -> smallest reachable, by all pairs."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def all_pairs(prints, radius=3):
    """doc_id -> smallest reachable, by all pairs of different fingerprints, in NumPy."""
    codes, at = np.unique(np.array(list(prints.values()), dtype=np.uint64), return_inverse=True)
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= radius) + i + 1:
            parent[root(int(j))] = root(i)
    least = {}
    for k, c in zip(prints, at.tolist(), strict=True):
        least[root(c)] = min(k, least.get(root(c), k))
    return {k: least[root(c)] for k, c in zip(prints, at.tolist(), strict=True)}


@pytest.mark.parametrize("folder, shard_rows", [("sf0.001", 4096), ("sf0.01", 4096), ("sf0.01", 60)])
def test_documents_against_all_pairs(spark, folder, shard_rows):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    prints = {r.doc_id: brute(r.text) for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in s.near_duplicates(docs, shard_rows=shard_rows).collect()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {k: r.component_id for k, r in got.items()} == all_pairs(prints)


def test_vantage_points_part_and_prune_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = s.stage_table(s.fingerprint_table(docs).groupBy("fp").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "rep"), "fps")
    n = table.count()
    trees = s.plan_trees(table, 3, 60, n)
    rows = s.dealt(table, trees).toPandas()
    for tree in (0, 1):
        mine = rows[rows.tree == tree]
        home = mine[~mine["query"]]
        assert len(home) == n == home.fp.nunique() and home.groupby("shard").size().max() < 200
        assert home.shard.nunique() >= 8 and mine["query"].any()
        assert len(mine) < 3 * n  # what the boundaries cost
    codes = table.toPandas()["fp"].to_numpy().view(np.uint64)
    for mask, rho in s.metrics(3):
        tree = s.VPTree(codes, mask, rho, 3)
        tree.linked()
        assert tree.splits >= 7 and tree.pruned > 0.6 * tree.followed and tree.compared < 0.5 * n * n


def test_hot_parts_are_split_exactly(spark):
    """Thousands of codes in one part: vantage points split it, boundaries are queried, nothing is lost."""
    rng = random.Random(1)
    codes = set()
    for _ in range(1500):
        x = 0x0123456789ABCDEF
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randint(0, 39)
        codes.add(x)
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(sorted(codes))]
    want = components({i: x & (1 << 64) - 1 for x, i in rows})
    d = spark.createDataFrame(rows, "fp long, rep long")
    for shard in (4096, 60):
        got = {r.node: r.component for r in s.components(s.links(d, 3, shard)).collect()}
        assert {i: got.get(i, i) for i in want} == want


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 6])
def test_trees_lose_no_link(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    family = np.full(900, 0x0123456789ABCDEF, dtype=np.uint64)
    for _ in range(5):
        family ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    copies = base.copy()
    for _ in range(radius):
        copies ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    half = (np.arange(700, dtype=np.uint64) * np.uint64(2654435761)) << np.uint64(32)  # one low half
    codes = np.unique(np.concatenate((base, copies, family, half)))
    want = all_pairs(dict(enumerate(codes.tolist())), radius)
    for home in (len(codes), 700):  # the rest are queries, in batches
        parent = list(range(len(codes)))
        root = lambda x: x if parent[x] == x else root(parent[x])
        deal = rng.permutation(len(codes))
        for tree in (0, 1):
            shard = s.Shard(tree, codes[deal[:home]], deal[:home], radius)
            found = [shard.edges()] + [shard.edges(codes[deal[k : k + 100]], deal[k : k + 100]) for k in range(home, len(codes), 100)]
            for a, b in zip(*(np.concatenate(v).tolist() for v in zip(*found, strict=True)), strict=True):
                assert (int(codes[a]) ^ int(codes[b])).bit_count() <= radius
                parent[root(a)] = root(b)
        if home == len(codes):
            assert len({root(i) for i in range(len(codes))}) == len(set(want.values()))
        else:  # all links with a home code are found, by one tree or the other
            near = np.bitwise_count(codes[deal[:home]][:, None] ^ codes[None, :]) <= radius
            assert all(root(int(deal[i])) == root(int(j)) for i, j in zip(*np.nonzero(near), strict=True))


def test_one_half_is_always_near():
    """Whatever bits of a link differ, one tree's bound holds."""
    rng = random.Random(3)
    for radius in range(1, 9):
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any((x & int(mask)).bit_count() <= rho for mask, rho in s.metrics(radius))


def test_long_chains_settle(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in s.components(e).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000} or {k: v for k, v in got.items() if k != v} == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_odd_rows(odd_docs, no_docs):
    rows = s.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "0" * 16
    assert {by[i].component_id for i in (2, 3, 4)} == {2} and by[8].component_id == 1
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    kept = s.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r.component_id for r in rows} - {None})
    assert s.near_duplicates(no_docs).count() == 0 and s.deduplicated(no_docs).count() == 0


def test_unlike_texts_of_one_id_stay(spark):
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(80)) for _ in range(4))
    rows = [(3, a.upper(), "x"), (5, a, "x"), (5, b, "x"), (7, b.upper(), "x"), (9, c, "x"), (9, d, "x"), (9, d, "x"), (9, d, "y"), (None, a, "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted((r.doc_id or 0, r.text) for r in s.deduplicated(docs.repartition(n)).collect()) for n in (1, 4)]
    assert got[0] == got[1] == sorted([(3, a.upper()), (5, b), (9, c), (9, d), (0, a), (0, a)])
