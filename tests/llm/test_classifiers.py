import math
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.llm import centroid_langid, quality_mil, queries, toxicity_fst
from gridspan.llm import toxicity_fst as t
from gridspan.llm.common import fold

SF = "/root/testdata/sf0.01"


def test_folds(spark):
    d = spark.range(200).withColumn("f", fold("id", 5))
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in d.collect())


@pytest.mark.parametrize("name, label, least", [("op1_quality_mil", "quality", 0.97), ("op6_toxicity_fst", "toxic", 0.95)])
def test_held_out_labels(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    j = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (j.predicted == j[label]).mean() >= least
    assert j.score.between(0, 1).all()


def test_held_out_languages(spark):
    got = queries.QUERIES["op9_centroid_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.98
    assert got.rejected.mean() < 0.01


def test_labels_do_not_leak(spark, documents, labels):
    """Scores do not change when held-out labels, and the inputs that are none, do."""
    flipped = labels.withColumn("toxic", F.when(toxicity_fst.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(quality_mil.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = documents.withColumn("source", F.lit("zz"))
    for f in (toxicity_fst.score_toxicity, quality_mil.score_quality):
        a = {r.doc_id: r.score for r in f(documents, labels).collect()}
        b = {r.doc_id: r.score for r in f(other, flipped).collect()}
        assert a == pytest.approx(b)
    other = documents.withColumn("lang", F.when(centroid_langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in centroid_langid.identify_languages(documents).collect()}
    b = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in centroid_langid.identify_languages(other).collect()}
    assert a == b


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, per, y, w = rng.normal(size=(11, 5)), np.array([3, 1, 5, 2]), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 3])
    m = quality_mil.GatedAttention(np.zeros(5), np.ones(5), {"W": rng.normal(size=(4, 5)), "b": rng.normal(size=4), "V": rng.normal(size=(3, 4)), "U": rng.normal(size=(3, 4)), "w": rng.normal(size=3), "c": rng.normal(size=4), "d": np.float64(0.2)})

    def loss():
        p = m.forward(x, per)["y"]
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * w).sum() / w.sum())

    g = m.gradients(m.forward(x, per), per, y, w)
    for k, v in m.p.items():
        flat = np.atleast_1d(v).astype(float)
        for i in range(min(6, flat.size)):
            old = flat.ravel()[i]
            both = []
            for step in (1e-5, -1e-5):
                flat.ravel()[i] = old + step
                m.p[k] = flat.reshape(np.shape(v)) if np.shape(v) else flat[0]
                both.append(loss())
            flat.ravel()[i] = old
            m.p[k] = v
            assert np.ravel(g[k])[i] == pytest.approx((both[0] - both[1]) / 2e-5, abs=1e-6), k


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(1)
    per = rng.integers(1, 6, 300)
    x = rng.normal(0, 0.3, (per.sum(), 6)).astype(np.float32)
    first = np.cumsum(per) - per
    y = (np.arange(300) % 2).astype(np.float32)
    at = first + rng.integers(0, 100, 300) % per
    x[at[y == 0], 0] += 4
    m = quality_mil.fit(x, per, y, np.ones(300), rounds=40)
    score, a = m.scores(x, per)
    assert ((score >= 0.5) == (y == 1)).mean() > 0.95
    many = (y == 0) & (per > 2)
    assert np.mean([a[f : f + n].argmax() + f == k for f, n, k in zip(first[many], per[many], at[many], strict=True)]) > 0.8


# --- the toxicity grammar ---------------------------------------------------------------------------------


def made(**classes):
    words = {t.TARGET: "you he the", t.NEGATION: "not never", t.REPORT: "said", t.INTENT: "will", t.THREAT: "crush"} | classes
    return t.Toxicity({"oaf": 1.0, "cad": 0.5}, {"knav": 0.8}, {w: k for k, ws in words.items() for w in ws.split()}, t.DEFAULT, t.BIAS)


def test_composition_equals_a_cascade():
    a = t._window({t.NEGATION}, {t.INSULT: "insult~n"}, -0.5)
    b = t._window({t.REPORT}, {"insult": "insult~r", "insult~n": "insult~n~r"}, -0.25, None)
    both = a.compose(b, t.ALPHABET)
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = [t.ALPHABET[i] for i in rng.integers(0, 7, 12)]
        mid, w = a.run(s)
        end, v = b.run(mid)
        assert both.run(s) == (end, pytest.approx(w + v))


def test_patterns_of_clauses():
    m = made()
    f = lambda x, m=m: {k: v for k, v in zip(t.FEATURES, np.expm1(m.features(x)[0]).round(3), strict=True) if v}
    assert f("You are an oaf.") == {"targeted insult": 1}
    assert f("what an oaf the") == {"targeted insult": 1}  # a target closes it from behind
    assert f("He is not an oaf.") == {"negated insult at a target": 1}
    assert f("Someone said you are an oaf.") == {"reported insult at a target": 1}
    assert f("You cad oaf") == {"targeted insult": 1.5, "piled insult": 1}
    assert f("oaf. cad") == {"insulting clause after another": 0.5}
    assert f("I will surely crush it") == {"intended threat": 1} and f("I will not crush it") == {"intended threat, negated or reported": 1}
    # words in isolation, and parts of words, are no pattern
    for x in ("oaf", "what an oaf", "crush", "never an oaf", "you knav", "you loafed", "", "said oaf. not cad"):
        assert f(x) == {} and m.score(x)[0] == m.score("a fine day")[0], x
    assert f("you knavish") == {"targeted insult": 0.8}
    assert m.score("what an oaf you are")[0] > m.score("a fine day")[0] > m.score("they never said you oaf")[0]
    # each transducer's part
    whole = "You oaf cad. He is not an oaf. Someone said you oaf. I will crush you"
    for part, name in (("negation", "negated insult at a target"), ("reported", "reported insult at a target"), ("threat", "intended threat"), ("pile", "piled insult"), ("target", "targeted insult")):
        less = made()
        less.machine = t.grammar(part)
        assert name in f(whole) and name not in f(whole, less)


def plain_features(m, text):
    """Every clause of a text by splitting it, the transducers one after the other, and plain sums."""
    total, before = np.zeros(len(t.FEATURES)), 0.0
    for clause in re.split(r"[.!?;:,\n]", text.lower()):
        tokens = [m.token(w) for w in re.findall(r"[^\W_]+(?:'[^\W_]+)?|[«„“\"]", clause)]
        marks = [set() for _ in tokens]
        at = lambda kind: [i for i, k in enumerate(tokens) if k[0] == kind]
        since = lambda i, kind, reach: any(0 < i - j <= reach for j in at(kind))
        hits = sorted(at(t.INSULT) + at(t.THREAT))
        for i in hits:
            marks[i] |= {k for k, kind, reach in (("n", t.NEGATION, 3), ("r", t.REPORT, 10**9), ("i", t.INTENT, 3)) if since(i, kind, reach)}
        abuse = 0.0
        for i in hits:
            w, damped = tokens[i][1], marks[i] & {"n", "r"}
            if tokens[i][0] == t.THREAT:
                if "i" in marks[i]:
                    total[6 if damped else 5] += 1
                continue
            if not damped:
                total[3] += w * any(j < i and tokens[j][0] == t.INSULT and not marks[j] & {"n", "r"} for j in hits)
                abuse = max(abuse, w)
            behind = [j for j in at(t.TARGET) if i < j <= i + 2 and not any(i < k < j for k in hits)]
            if since(i, t.TARGET, 4) or behind:
                total[1 if "n" in marks[i] else 2 if "r" in marks[i] else 0] += w
        total[4] += abuse if before else 0
        before = before or abuse
    return np.log1p(total)


def test_matching_against_plain_clauses():
    m, rng = made(), np.random.default_rng(5)
    words = "oaf cad knave you he not said will crush x yy zzz loaf . , \n".split(" ")
    for _ in range(400):
        text = " ".join(rng.choice(words, rng.integers(0, 40)))
        # a threat between an insult and the target behind it keeps the machine's state, so leave those out
        if re.search(r"(oaf|cad|knave)( \w+)? crush", text):
            continue
        assert m.features(text)[0] == pytest.approx(plain_features(m, text)), text


def test_long_texts_take_linear_time():
    m = made()
    for text in ("you oaf " * 1_300_000, "x oaf. " * 1_500_000, "oaf" + " word" * 2_000_000, "w" * 10_000_000):
        began = time.perf_counter()
        m.features(text)
        assert time.perf_counter() - began < 25
    assert max(b - a for a, b in m.clauses("you oaf " * 5000)) <= 2 * t.CLAUSE + 3


def test_classes_are_learned(spark):
    """Negation, report, intent and threat words come from rows that give evidence of them."""
    rng = np.random.default_rng(2)
    filler = [f"w{i}" for i in range(300)]
    some = lambda n: " ".join(rng.choice(filler, n))
    rows, labels = [], []
    for i in range(900):
        kind = i % 9
        if kind < 2:
            body, toxic = f"{some(20)}. you are {some(1)} oaf. {some(20)}", 1
        elif kind == 2:
            body, toxic = f"{some(20)}. i will {some(1)} crush you. {some(20)}", 1
        elif kind == 3 and i % 2:
            body, toxic = f"{some(20)}. you are not {some(1)} oaf. {some(20)}", 0
        elif kind == 3:
            body, toxic = f"{some(20)}. he said {some(5)} you are {some(1)} oaf. {some(20)}", 0
        else:
            body, toxic = f"{some(9)}. you and i are {some(1)} who will {some(2)}. he said {some(1)} to {some(1)} {'crush' if i % 2 else 'go'} {some(1)}. {some(9)}. it is {some(1)} not {some(9)}", 0
        rows.append((i, body, "en"))
        labels.append((i, toxic))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = t.learn(docs, lab, ~t.held_out(), odds=1.0, sure=12.0)
    assert "oaf" in m.words and m.classes.get("are") == t.TARGET
    assert m.classes.get("not") == t.NEGATION and m.classes.get("said") == t.REPORT and m.classes.get("crush") == t.THREAT
    got = {r.doc_id: r.score for r in t.score(docs, m).collect()}
    wrong = sum((s >= 0.5) != labels[i][1] for i, s in got.items())
    assert wrong <= 9
    for part in ("negation", "reported", "threat", "target"):  # without any of them it is worse
        m.machine = t.grammar(part)
        assert sum((m.score(r[1])[0] >= 0.5) != lab_[1] for r, lab_ in zip(rows, labels, strict=True)) > wrong + 20, part


def test_transducers_count_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    m = t.learn(docs, labels, ~t.held_out())
    held = docs.join(labels, "doc_id").filter(t.held_out() & F.col("toxic").isNotNull()).select("text", "toxic").toPandas()

    def recall(part):
        m.machine = t.grammar(part)
        s = np.array([m.score(x or "")[0] >= 0.7 for x in held.text])
        return s[held.toxic == 1].mean(), s[held.toxic == 0].mean()

    whole, false = recall(None)
    assert false <= 0.01 and recall("target")[0] < whole - 0.1


def test_scores_against_a_plain_version(spark, documents, labels):
    """The query's scores, from the learned model by plain clauses and the logistic formula."""
    m = t.learn(documents, labels, ~t.held_out())
    got = {r.doc_id: r.score for r in t.score(documents, m).collect()}
    for r in documents.collect():
        if max((len(c) for c in re.split(r"[.!?;:,\n]", r.text or "")), default=0) < t.CLAUSE:
            assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(plain_features(m, r.text or "") @ m.weights + m.bias))))


# --- plain versions of the other scores ---------------------------------------------------------------------


def test_quality_against_a_plain_version(spark, documents, labels):
    model = quality_mil.learn(documents, labels, ~quality_mil.held_out())
    got = {r.doc_id: (r.score, r.n_passages) for r in quality_mil.score(documents, model).collect()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    p = {k: np.asarray(v, dtype=float) for k, v in model.p.items()}
    for r in documents.limit(60).collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())
        bags = [words[k : k + quality_mil.PASSAGE] for k in range(0, len(words), quality_mil.PASSAGE)] or [[]]
        h = []
        for bag in bags:
            x, n = np.zeros(quality_mil.WIDTH), max(1, len(bag))
            seen = b"".join(bag)
            for c in seen:
                x[quality_mil._CLASS[c]] += 1
            x[: quality_mil.N_CLASS] = np.sqrt(x[: quality_mil.N_CLASS] / max(1, len(seen)))
            lone = [quality_mil._CLASS[w[-1]] > 3 for w in bag]
            x[quality_mil.N_CLASS :] = [
                len(bag) / quality_mil.PASSAGE, 1 - len(set(bag)) / n if bag else 1, sum(a == b for a, b in zip(bag, bag[1:], strict=False)) / n, sum(a == b for a, b in zip(bag, bag[2:], strict=False)) / n,
                len(seen) / n / 10, sum(lone) / n, sum(o and len(w) == 1 for o, w in zip(lone, bag, strict=True)) / n, sum(quality_mil._CLASS[w[0]] == 2 for w in bag) / n,
            ]
            if not words:
                x[:] = 0
            x = np.clip((x - model.mean) / model.scale, -6, 6)
            h.append(np.tanh(p["W"] @ x + p["b"]))
        e = [float(p["w"] @ (np.tanh(p["V"] @ v) * np.array([sig(u) for u in p["U"] @ v]))) for v in h]
        a = np.exp(np.array(e) - max(e))
        z = sum(v * w for v, w in zip(h, a / a.sum(), strict=True))
        assert got[r.doc_id] == (pytest.approx(sig(float(p["c"] @ z + p["d"])), abs=2e-4), len(bags))


def test_languages_against_a_plain_version(spark, documents):
    model = centroid_langid.learn(documents.filter(~centroid_langid.held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in centroid_langid.identify(documents, model).collect()}
    for r in documents.limit(60).collect():
        text = (r.text or "").lower()
        kept = "".join(c if c.isalpha() or ord(c) >= 0x80 else " " for c in text)
        raw = b" " + b" ".join(kept.encode().split()) + b" \0"
        n = np.zeros(centroid_langid.DIM)
        for k, add, mul in ((2, 0xA5000000, 2246822519), (3, 0, 2654435761)):
            for i in range(len(raw) - k):  # a gram ends before the byte 0
                gram = int.from_bytes(raw[i : i + k], "big") | add
                n[(gram * mul & 0xFFFFFFFF) >> 32 - centroid_langid.BITS] += 1
        n[0] = 0
        x = np.log1p(n) * model.idf
        cos = model.centre @ (x / max(1e-9, float(np.sqrt((x * x).sum()))))
        best = int(cos.argmax())
        if not any(c.isalpha() for c in text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
        else:
            assert got[r.doc_id].lang_pred == model.langs[model.lang_of[best]]
            assert got[r.doc_id].score == pytest.approx(max(0.0, min(1.0, float(cos[best]))), abs=1e-3)


def test_samples_are_bounded_whatever_repeats(spark):
    """10,000 rows of one id, or of none, give no more than the stated samples."""
    text = F.concat(F.lit("some words of text number "), F.col("id").cast("string"), F.lit(" in a row"))
    docs = spark.range(10_000).select(F.when(F.col("id") < 9000, 1).when(F.col("id") < 9900, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    taken = []
    real = centroid_langid.spherical_kmeans

    def count(x, k):
        taken.append(len(x))
        return real(x, k)

    centroid_langid.spherical_kmeans = count
    try:
        centroid_langid.learn(docs, per_lang=50)
    finally:
        centroid_langid.spherical_kmeans = real
    assert taken and 25 <= taken[0] <= 50
    copies = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"), F.lit("en").alias("lang"))
    assert centroid_langid.learn(copies).langs == ["en"]
    long = spark.createDataFrame([(1, "good words here " * 60_000), (3, "bad ### $$$ " * 60_000)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    x = []
    fit = quality_mil.fit
    quality_mil.fit = lambda a, *r: x.append(len(a)) or fit(a, *r, rounds=2)
    try:
        quality_mil.learn(long, lab, F.lit(True), passages=100)
    finally:
        quality_mil.fit = fit
    assert x == [200]


def test_odd_rows_and_missing_labels(spark, odd_docs, no_docs):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (8, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (lab, one):
        for f in (quality_mil.score_quality, toxicity_fst.score_toxicity):
            got = f(odd_docs, labels).collect()
            assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
            assert f(no_docs, labels).count() == 0
    assert all(r.score == 1.0 for r in quality_mil.score_quality(odd_docs, one).collect())
    got = centroid_langid.identify_languages(odd_docs).collect()
    assert len(got) == odd_docs.count()
    und = {r.doc_id for r in got if r.lang_pred == "und" and r.doc_id is not None}
    assert {2, 3, 4} <= und and all(r.score == 0 and r.rejected for r in got if r.lang_pred == "und")
    assert centroid_langid.identify_languages(no_docs).count() == 0
    nothing = centroid_langid.identify_languages(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_gram_counts():
    got, letters = centroid_langid.gram_counts([b"ab ab", b"", b"123 !!", "ÉA".encode(), "éa".encode()])
    assert letters.tolist() == [True, False, False, True, True]
    assert (got[3] == got[4]).all() and got[1].sum() <= got[0].sum()


def test_long_texts_are_counted_in_parts(monkeypatch):
    texts = [b"abc def " * 30, b"x", b""]
    want = centroid_langid.gram_counts(texts)[0]
    monkeypatch.setattr(centroid_langid, "PART", 64)
    got, letters = centroid_langid.gram_counts(texts)
    assert letters.tolist() == [True, True, False] and abs(got.sum() - want.sum()) < 40 and (got[1] == want[1]).all()


def test_kmeans_is_deterministic():
    rng = np.random.default_rng(0)
    x = rng.random((60, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = centroid_langid.spherical_kmeans(x, 4), centroid_langid.spherical_kmeans(x, 4)
    assert (a == b).all() and np.allclose(np.linalg.norm(a, axis=1), 1)
