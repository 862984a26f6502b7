import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspan.llm import queries, rans_tokens as r
from gridspan.llm.common import WordTable, tokenizer_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60000), max_size=4000), st.integers(0, 2**40))
def test_blocks_round_trip(ids, start):
    ids = np.array(ids, dtype=np.uint32)
    table = r.Table(np.bincount(ids, minlength=65536) * 1000 + (np.arange(65536) == 7))
    head, back = r.decode_block(r.encode_block(ids, [1, 5], [len(ids), 0], start, table), table)
    assert back.tolist() == ids.tolist() and head["start"] == start and head["doc_ids"].tolist() == [1, 5]


def test_checkpoints_decode_alone():
    ids = np.random.default_rng(0).integers(0, 500, 3 * r.CHECK_STEPS * r.LANES + 77).astype(np.uint32)
    table = r.Table(np.bincount(ids, minlength=65536))
    head = r.block_head(r.encode_block(ids, [1], [len(ids)], 0, table))
    n = r.CHECK_STEPS * r.LANES
    assert len(head["points"]) == 4
    for k in (3, 1, 0, 2):
        assert (r.decode_steps(head, table, k) == ids[k * n : (k + 1) * n]).all()


def test_damage_is_found():
    ids = np.arange(3000, dtype=np.uint32) % 100
    table = r.Table(np.bincount(ids, minlength=65536))
    block = bytearray(r.encode_block(ids, [1], [3000], 0, table))
    block[-3] ^= 1
    with pytest.raises(ValueError):
        r.decode_block(bytes(block), table)
    with pytest.raises(ValueError):
        r.encode_block(np.array([101], dtype=np.uint32), [1], [1], 0, table)


def test_size_is_near_the_entropy():
    ids = np.minimum(np.random.default_rng(1).zipf(1.4, 300_000), 50_000).astype(np.uint32)
    p = np.bincount(ids) / len(ids)
    p = p[p > 0]
    table = r.Table(np.bincount(ids, minlength=65536))
    assert len(r.encode_block(ids, [1], [len(ids)], 0, table)) * 8 / len(ids) < 1.1 * -(p * np.log2(p)).sum()
    assert table.freq.sum() == 1 << r.SCALE


def brute(rows):
    tk = WordTable.at(tokenizer_path()).tk
    out, at = [], 0
    for i, t in sorted(rows, key=lambda x: x[0]):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_documents(spark, documents, sf):
    got = sorted(tuple(x) for x in queries.QUERIES["op5_rans_tokens"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute([(x.doc_id, x.text) for x in documents.collect()])


def test_many_ranges_and_files(spark, documents, tmp_path):
    path = str(tmp_path / "t")
    table = r.write_binary(documents.repartition(5), path, block_ids=2000, per_bucket=17)
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("start").collect()
    assert len(blocks) > 20 and [b.first_doc for b in blocks] == sorted(b.first_doc for b in blocks)
    assert sum(r.block_head(bytes(b.block))["n"] for b in blocks) == sum(n for _, _, n, _ in brute([(x.doc_id, x.text) for x in documents.collect()]))
    got = sorted(tuple(x)[:4] for x in r.read_binary(spark, path, with_ids=True).collect())
    assert got == brute([(x.doc_id, x.text) for x in documents.collect()])
    assert (r.read_table(spark, path).freq == table.freq).all()


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    rows = r.round_trip(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    named = odd_docs.filter("doc_id IS NOT NULL")
    got = sorted(tuple(x) for x in rows if x.doc_id is not None)
    assert got == sorted(brute([(x.doc_id, x.text) for x in named.collect()]))
    last = sorted((x.start, x.n_tokens) for x in rows if x.doc_id is None)
    assert len(last) == 2 and last[0][0] == sum(n for _, _, n, _ in got) and last[1][0] == sum(last[0])
    assert r.round_trip(no_docs).count() == 0
