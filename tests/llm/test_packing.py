import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.llm import bin_completion as b
from gridspan.llm import queries
from gridspan.llm.common import WordTable, tokenizer_path


def fill(fillings):
    out = {}
    for times, parts in fillings:
        assert sum(s * k for s, k in parts) <= 1024
        for s, k in parts:
            out[s] = out.get(s, 0) + times * k
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_the_histogram_exactly(seed):
    rng = random.Random(seed)
    hist = {rng.randint(1, 1024): rng.randint(1, 400) for _ in range(rng.randint(1, 300))}
    got = b.plan(hist)
    assert fill(got) == hist
    assert sum(t for t, _ in got) <= 1.04 * lower_bound(hist) + 2


def lower_bound(hist, cap=1024):
    """Martello and Toth's L2."""
    least = 0
    for a in range(0, cap // 2 + 1, 4):
        alone = sum(n for s, n in hist.items() if s > cap - a)
        large = [(s, n) for s, n in hist.items() if cap // 2 < s <= cap - a]
        small = sum(s * n for s, n in hist.items() if a <= s <= cap // 2)
        bins = sum(n for _, n in large)
        room = bins * cap - sum(s * n for s, n in large)
        least = max(least, alone + bins + max(0, -(-(small - room) // cap)))
    return least


def best(sizes, cap):
    """The least number of bins, by trying everything."""
    sizes = sorted(sizes, reverse=True)
    result = len(sizes)

    def go(i, bins):
        nonlocal result
        if len(bins) >= result:
            return
        if i == len(sizes):
            result = len(bins)
            return
        for k, room in enumerate(bins):
            if room >= sizes[i] and room not in bins[:k]:
                go(i + 1, [*bins[:k], room - sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, cap - sizes[i]])

    go(0, [])
    return result


@pytest.mark.parametrize("seed", range(8))
def test_small_plans_against_brute_force(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(100, 700) for _ in range(9)]
    hist = {s: sizes.count(s) for s in set(sizes)}
    assert sum(t for t, _ in b.plan(hist)) <= best(sizes, 1024) + 1


def test_the_best_filling_is_found():
    sizes = np.array([700, 400, 300, 299, 1])
    assert sum(s * k for s, k in b.complete(600, sizes, np.array([1, 1, 1, 1, 1]))) == 600
    assert b.complete(598, sizes, np.array([0, 0, 0, 2, 0])) == [(299, 2)]
    assert b.complete(50, sizes, np.array([1, 1, 1, 1, 0])) == []


def check(rows, texts):
    """Pieces are the cuts of each document; sequences are gapless from 0."""
    tk = WordTable.at(tokenizer_path()).tk
    want = []
    for i, t in texts:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, len(ids)] if len(ids) <= 1024 else [0, *range(first, len(ids), 1024), len(ids)]
        want += [(str(i), k, x, y - x, zlib.crc32(ids[x:y].tobytes())) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    return len(seqs)


def test_documents(spark, documents, sf):
    rows = queries.QUERIES["op7_bin_completion"](spark, sf).collect()
    n = check(rows, [(x.doc_id, x.text) for x in documents.collect()])
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def test_salted_ranks(spark, documents):
    pieces = b.token_pieces(documents).repartition(5)
    check(b.pack(pieces, per_bucket=13).collect(), [(x.doc_id, x.text) for x in documents.collect()])


def test_pieces_of_one_length_are_spread(spark):
    """One text copied 50,000 times: its pieces of equal length do not meet in one task."""
    pieces = spark.range(50_000).selectExpr("id as doc_id", "7L as row", "0 as piece", "0L as start", "if(id % 10 = 0, 300L, 1024L) as length", "1L as ids_crc32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = b.pack(pieces)
        per_task = out.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        got = out.toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert per_task.max() < 0.3 * 50_000
    assert len(got) == 50_000 == len(got.drop_duplicates(["sequence_id", "offset"]))
    assert got[got.length == 1024].sequence_id.nunique() == 45_000 and got.groupby("sequence_id").length.sum().max() <= 1024
    assert got.sequence_id.nunique() == 45_000 + -(-5_000 // 3)


def test_searches_that_are_cut_are_noted():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.choice(np.arange(40, 500), 200, replace=False))[::-1]
    cut = []
    b.complete(1023, sizes * 2 + 1, np.ones(200, dtype=int), effort=3, cut=cut)
    assert cut in ([], [1023])
    assert b.complete(7, np.array([8]), np.array([1]), cut=cut) == []


def test_odd_rows(odd_docs, no_docs):
    check(b.pack_documents(odd_docs).collect(), [(x.doc_id, x.text) for x in odd_docs.collect()])
    assert b.pack_documents(no_docs).count() == 0
