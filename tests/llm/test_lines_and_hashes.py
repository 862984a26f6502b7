import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridspan.llm import line_frequency as lf
from gridspan.llm import multiset_hash as mh
from gridspan.llm import queries

WORD = r"[^\x20\x09-\x0D]+"


def base(t):
    t = t or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, cov = Counter(win), set()
    for i, x in enumerate(win):
        if n[x] > 1:
            cov.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov)


def norm(line):
    return tuple(re.findall(WORD, re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line))))


def brute(rows, least, share=0.01, min_words=20, min_left=0.3):
    doc = lambda r: ("text", r.text) if r.doc_id is None else r.doc_id
    seen, hosts = {}, {}
    for r in rows:
        hosts.setdefault(r.source, set()).add(doc(r))
        for line in {norm(x) for x in (r.text or "").split("\n")} - {()}:
            seen.setdefault((r.source, line), set()).add(doc(r))
    out = []
    for r in rows:
        b = base(r.text)
        limit = max(least, share * len(hosts[r.source]))
        gone = sum(len(norm(x)) for x in (r.text or "").split("\n") if norm(x) and len(seen[r.source, norm(x)]) > limit)
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        left = b[0] - gone
        out.append((str(r.doc_id), *b, gone, failed, not failed and not (gone and (left < min_words or left < min_left * b[0]))))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.removed_words, r.base_failed, r.kept) for r in df.collect())


@pytest.mark.parametrize("least, share", [(1, 0.0), (1, 0.2), (3, 0.01), (64, 0.01)])
def test_rules_against_brute_force(documents, least, share):
    assert rows_of(lf.rule_documents(documents, min_docs=least, share=share)) == brute(documents.collect(), least, share)


def test_query_is_the_operator(spark, documents, sf):
    assert rows_of(queries.QUERIES["op8_line_frequency"](spark, sf)) == brute(documents.collect(), lf.MIN_DOCS, lf.SHARE)


def test_boilerplate_goes_and_documents_count(spark):
    rng = random.Random(0)
    own = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 9)) + rng.choice("xyz") for _ in range(30))
    foot = "Read the terms of use and the privacy policy on this page, and subscribe to our letter today."
    rows = [(i, own() + "\n" + foot, "h") for i in range(10)] + [(100, "\n".join([foot] * 3), "h")]
    once, often, same = own(), own(), own()
    rows += [(200 + i, once, f"host {i}") for i in range(30)]  # one copy on each host
    rows += [(300 + i, often, "h") for i in range(30)]  # copies are documents
    rows += [(400, same, "h")] * 30  # one document, whatever its rows
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in lf.rule_documents(d, min_docs=5).collect()}
    assert all(got[i].kept and got[i].removed_words == 18 for i in range(10))
    assert not got[100].kept and got[400].kept
    assert all(got[200 + i].kept and not got[200 + i].removed_words for i in range(30))
    assert not any(got[300 + i].kept for i in range(30))
    # of the host's 42 documents, 30 hold the copied lines and 11 the footer
    assert all(r.removed_words == 0 for r in lf.rule_documents(d, min_docs=5, share=0.8).collect())
    stripped = {r.doc_id: r.text for r in lf.strip_lines(d, min_docs=5).collect()}
    assert stripped[3] == rows[3][1].split("\n")[0] and stripped[205] == once and stripped[305] == ""


def test_one_text_copied_very_often(spark, monkeypatch):
    """Hot lines and hot texts take the way that spreads them, with the same result."""
    from gridspan.llm import common

    line = "a line that a third of the host has " * 3
    rows = [(i, "\n".join([f"own {i} " + "word " * 25, *([line] if i % 3 == 0 else [])]), "h") for i in range(600)]
    rows += [(1000 + i, line, "h") for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = brute(d.collect(), 64)
    for hot in (4096, 50):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        assert rows_of(lf.rule_documents(d)) == want
    assert lf.strip_lines(d).filter("doc_id >= 1000").select("text").distinct().collect()[0].text == ""


def test_odd_rules(odd_docs, no_docs):
    assert rows_of(lf.rule_documents(odd_docs, min_docs=1, share=0.0)) == brute(odd_docs.collect(), 1, 0.0)
    assert lf.rule_documents(no_docs).count() == 0 and lf.strip_lines(no_docs).count() == 0
    clash = odd_docs.withColumns({n: F.lit(i) for i, n in enumerate(["row", "text_hash", "host_key", "gone", "line", "words", "_drop", "_rows", "a.b"])})
    s = lf.strip_lines(clash, min_docs=1, share=0.0)
    assert s.columns == clash.columns
    assert s.count() == odd_docs.count() and s.filter("text IS NULL").count() == 2
    assert s.drop("text").exceptAll(clash.drop("text")).isEmpty()
    assert lf.strip_lines(clash).exceptAll(clash).isEmpty()
    gone = {r.doc_id: r.text for r in s.collect()}
    assert gone[1] == "" and gone[9] == "x"  # doc 8 repeats doc 1's only line


# --- multiset hash ----------------------------------------------------------------------------------------


def fp(*texts):
    return mh.Fingerprints.of([t.encode() for t in texts])


def test_order_does_not_matter_and_pieces_come_and_go():
    a, b, c = "one two three\n", "four five\n", "six seven eight nine\n"
    f = fp(a + b + c, c + a + b, a + c, b, a + b + b + c)
    assert f.hex()[0] == f.hex()[1]
    assert (f[[0]] - f[[3]]).hex() == f[[2]].hex()
    assert (f[[0]] + f[[3]]).hex() == f[[4]].hex()
    assert f.hex()[0] != f.hex()[4]  # a multiset
    assert mh.Fingerprints.from_hex(f.hex()).hex() == f.hex()


def test_equality_is_of_bytes():
    texts = ["", " ", "  ", "\n", "a", "a ", "a\n", "A", "a b", "a  b", "b a", "é", "日本"]
    assert len(set(fp(*texts).hex())) == len(texts)
    assert fp(*texts).hex() == fp(*texts).hex()


def test_likeness_follows_the_shared_part():
    rng = random.Random(0)
    words = [f"w{i}" for i in range(5000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    for share in (0.0, 0.25, 0.5, 0.9):
        got = []
        for _ in range(12):
            a, b = text(600), text(600)
            k = int(600 * share)
            got.append(fp(" ".join(a), " ".join(a[:k] + b[k:])))
        mean = sum(g[[0]].likeness(g[[1]])[0] for g in got) / len(got)
        assert abs(mean - share) < 0.12
    same = fp("x y z", "x y z")
    assert same[[0]].likeness(same[[1]])[0] == 1.0
    none = fp("", "")
    assert none[[0]].likeness(none[[1]])[0] == 1.0


@pytest.mark.parametrize("a, b", [(32_000, 33_000), (40_000, 20_000), (2**17, 2**16), (2**15, 2**15 + 1)])
def test_likeness_of_very_many_equal_lines(a, b):
    f = fp("one line\n" * a, "one line\n" * b, "one line\n" * a + "and one more\n")
    for g in (f, mh.Fingerprints.from_hex(f.hex())):
        assert g[[0]].likeness(g[[1]])[0] == pytest.approx(2 * a * b / (a * a + b * b), abs=0.01)
        assert 0.99 < g[[0]].likeness(g[[2]])[0] < 1


@pytest.mark.parametrize("per", [7, 50, 4000])
def test_pairs_in_descending_order(documents, per):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: r for r in mh.fingerprint_pairs(documents.repartition(3), per).collect()}
    ids = sorted(texts, reverse=True)
    assert len(got) == len(ids)
    for i, k in enumerate(ids):
        t, n = texts[k], texts[ids[(i + 1) % len(ids)]]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        f = fp(t, e, n)
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert [got[k].fingerprint, got[k].edited_fingerprint] == f.hex()[:2]
        assert got[k].near_edited == pytest.approx(f[[0]].likeness(f[[1]])[0]) and got[k].near_next == pytest.approx(f[[0]].likeness(f[[2]])[0])
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.95 * len(got)


def test_one_id_of_very_many_rows(spark):
    """Rows of a repeated id and rows without one are spread, and each is paired once."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i} of many") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = mh.fingerprint_pairs(d, 50).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), fp(t).hex()[0]) for i, t in rows)
    key = lambda r: (-(2**63) if r.doc_id is None else r.doc_id, r.h, r.text)
    order = sorted(d.withColumn("h", F.xxhash64("text")).collect(), key=key, reverse=True)
    want = {}
    for r, n in zip(order, order[1:] + order[:1], strict=True):
        half = len(r.text) // 2
        want[r.text] = hashlib.sha256((r.text[: len(r.text) - half] + n.text[:half]).encode()).hexdigest()
    assert sorted(r.edited_sha256 for r in got) == sorted(want.values())


def test_odd_pairs(spark, odd_docs, no_docs):
    got = mh.fingerprint_pairs(odd_docs, 3).collect()
    assert len(got) == odd_docs.count()
    assert sum(r.doc_id is None for r in got) == 2
    alone = mh.fingerprint_pairs(odd_docs.filter("doc_id = 1")).first()
    t = odd_docs.filter("doc_id = 1").first().text
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + t[: len(t) // 2]).encode()).hexdigest()
    assert mh.fingerprint_pairs(no_docs).count() == 0
