import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspan.llm import common
from gridspan.llm.common import TextBlock, WordTable, encode_ids, tokenizer_path

ODD = ["a\n b", "a.\nB c", "\n", "a\n", "\na", "a\n\nb", "x\n\n\ny", " \n", "a\0b c, d.", "He,", ",", "hi. ho, x.", "a\tb,\nc", "é,\nè. ñ,", "don't, it's. 5, 5.a", "a  b", "  a", "<|endoftext|> hi", "x <|endoftext|>", "", " ", "\t x  1 2", "x　y", "w" * 200 + " " + "z" * 90, "a \xa0b", "a.,b ,c .d", "“q” «w»", "日本 語、\nえ", ".\n,"]


def reference(text):
    return WordTable.at(tokenizer_path()).tk.encode(text, add_special_tokens=False).ids


def test_ids_of_odd_texts():
    ids, at = encode_ids([t.encode() for t in ODD], tokenizer_path(), end=True)
    for i, t in enumerate(ODD):
        assert ids[at[i] : at[i + 1]].tolist() == [*reference(t), 2], repr(t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,'ab1é日　\xa0<|>_", max_size=30), max_size=6))
def test_ids_are_the_librarys(texts):
    ids, at = encode_ids([t.encode() for t in texts], tokenizer_path())
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == reference(t)


def test_a_full_table_is_emptied(monkeypatch):
    monkeypatch.setattr(common, "TABLE_WORDS", 64)
    table = WordTable(tokenizer_path())
    for k in range(30):
        text = " ".join(f"w{k}x{i}" for i in range(200))
        ids, _ = table.encode([text.encode()])
        assert ids.tolist() == reference(text)


def test_colliding_hashes_are_kept_apart(monkeypatch):
    real = common._piece_hashes
    monkeypatch.setattr(common, "_piece_hashes", lambda *a: (np.ones(len(a[1]), dtype=np.uint64), real(*a)[1]))
    table = WordTable(tokenizer_path())
    for text in ("one two three one", "two four"):
        assert table.encode([text.encode()])[0].tolist() == reference(text)


def test_words_and_lines():
    texts = ["a b\n\nc", "", " x\ty ", "é　ü z"]
    b = TextBlock([t.encode() for t in texts])
    got = [b.raw[s:e] for s, e in zip(b.word_start, b.word_end, strict=True)]
    assert got == [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]
    assert b.n_words.tolist() == [3, 0, 2, 2]
    start, end, doc = b.lines()
    assert [(b.raw[s:e].decode(), d) for s, e, d in zip(start, end, doc, strict=True)] == [(line, i) for i, t in enumerate(texts) for line in t.split("\n")]
    h = b.hashes(b.word_start, b.word_end)
    assert len(set(h.tolist())) == len(set(got))


@pytest.mark.parametrize("n", [1, 7, 40])
def test_ranges(spark, n):
    d = spark.range(100).selectExpr("id * 3 as k", "xxhash64(id) as h")
    ranges = common.Ranges.of(d, "k", n)
    rows = d.select("k", ranges.column("k", "h").alias("b")).orderBy("k").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
    assert {r.b for r in rows} <= set(range(ranges.n)) and -(-100 // n) <= ranges.n <= 3 * -(-100 // n)
    assert max(Counter(r.b for r in rows).values()) <= 1.2 * n + 1


def test_a_hot_key_is_split_by_the_hash(spark):
    d = spark.range(20_000).selectExpr("if(id % 2 = 0, 5000, id) as k", "xxhash64(id) as h")
    ranges = common.Ranges.of(d, "k", 500)
    rows = d.select("k", "h", ranges.column("k", "h").alias("b")).toPandas()
    assert rows.groupby("b").size().max() < 1000
    hot, rest = rows[rows.k == 5000], rows[rows.k != 5000]
    assert not set(hot.b) & set(rest.b) and len(set(hot.b)) >= 18
    order = rows.sort_values(["k", "h"])
    assert (order.b.diff().dropna() >= 0).all()


def test_skew_join(spark, monkeypatch):
    left = common.stage_table(spark.range(3000).selectExpr("if(id % 3 = 0, 7, id % 50) as k", "id as v"), "left")
    right = spark.range(5, 40).selectExpr("id as k", "id * 2 as w")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "k", how).collect()))
        for hot in (4096, 100):
            monkeypatch.setattr(common, "HOT_ROWS", hot)
            assert sorted(map(str, common.skew_join(left, right, ["k"], how).select("k", "v", "w").collect())) == want


def test_labelled_sample_is_bounded(spark):
    docs = spark.range(10_000).selectExpr("if(id < 9000, 1, id) as doc_id", "concat('text ', id % 4000) as text").unionByName(spark.createDataFrame([(None, "x")] * 50, "doc_id long, text string"))
    labels = spark.range(1, 10_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    got = common.labelled_sample(docs, labels, "toxic", F.lit(True), 20)
    assert got.count() <= 40
    one = common.labelled_sample(docs, labels.filter("doc_id = 1"), "toxic", F.lit(True), 20).collect()
    assert len(one) == 1 and one[0].label == 1
    again = common.labelled_sample(docs.repartition(7), labels.filter("doc_id = 1"), "toxic", F.lit(True), 20).collect()
    assert one == again


def test_hashes_do_not_depend_on_steps(monkeypatch):
    texts = [("word%d " % i * 50).encode() for i in range(40)]
    b = TextBlock(texts)
    h, lines = b.hashes(b.word_start, b.word_end), b.hashes(b.start, b.end)
    monkeypatch.setattr(common, "HASH_STEP", 37)
    assert (b.hashes(b.word_start, b.word_end) == h).all() and (b.hashes(b.start, b.end) == lines).all()
    assert len(set(h.tolist())) == 40 and len(set(lines.tolist())) == 40


def test_bit_sums_do_not_depend_on_steps():
    rng = np.random.default_rng(0)
    doc = np.sort(rng.integers(0, 9, 500))
    wide = rng.integers(0, 2**63, (500, 2), dtype=np.uint64)
    want = np.zeros((10, 128), dtype=int)
    for d, row in zip(doc, wide, strict=True):
        want[d] += [int(row[k // 64]) >> 63 - k % 64 & 1 for k in range(128)]
    for step in (1, 7, 1000):
        assert (TextBlock.bit_sums(doc, 10, wide, step) == want).all()
