import hashlib
import math

import duckdb
import pytest

from gridspan.llm import poisson_mix, queries


def brute(u, mean):
    k, p, cum = 0, math.exp(-mean), 0.0
    while True:
        cum += p
        if u < cum:
            return k
        k += 1
        p *= mean / k


def u_of(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 2**48


def test_counts_are_poisson(spark):
    n = 4000
    d = spark.range(n).selectExpr("id as doc_id", "'a' as text", "if(id % 4 = 0, 'small', 'large') as source")
    w = spark.createDataFrame([("small", 3.0), ("large", 1.0), ("absent", 9.0)], "source string, weight double")
    got = poisson_mix.poisson_mix(d, w, total=8000.0, seed=5).toPandas()
    rate = {"small": 8000 * 3 / 13 / 1000 if False else 8000 * 3 / 4 / 1000, "large": 8000 / 4 / 3000}
    have = got.groupby("doc_id").size().to_dict()
    for i in range(n):
        assert have.get(i, 0) == brute(u_of(5, i, 1), rate["small" if i % 4 == 0 else "large"])
    mean = got[got.source == "small"].shape[0] / 1000
    assert abs(mean - 6) < 4 * math.sqrt(6 / 1000)
    assert (got.groupby("doc_id")["copy"].max() == got.groupby("doc_id").size()).all()


def test_large_rates_are_split(spark):
    d = spark.range(300).selectExpr("id as doc_id", "'a' as text", "'s' as source")
    got = poisson_mix.poisson_mix(d, total=300 * 150.0).groupBy("doc_id").count().toPandas()["count"]
    assert abs(got.mean() - 150) < 4 * math.sqrt(150 / 300) and 150 / 2 < got.var() < 150 * 2


def test_against_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.execute(queries.ORACLES["op2_poisson_mix"]).df()
    got = queries.QUERIES["op2_poisson_mix"](spark, sf).toPandas()
    key = ["doc_id", "copy"]
    a, b = (x.sort_values(key).reset_index(drop=True)[sorted(x.columns)] for x in (got, want))
    assert a.astype(str).equals(b.astype(str))


def test_no_python_on_the_path(spark, sf):
    plan = queries.QUERIES["op2_poisson_mix"](spark, sf)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "ExternalRDD"))


def test_odd_rows(spark, odd_docs, no_docs):
    got = poisson_mix.poisson_mix(odd_docs, total=60.0)
    assert set(got.columns) == set(odd_docs.columns) | set(poisson_mix.ADDED)
    rows = got.collect()
    assert {r.source for r in rows} <= {"s0", "s1", None} and len(rows) > 20
    assert sum(r.source is None for r in rows) > 0
    assert len({r.n_copies for r in rows if r.doc_id == 8}) == 1
    assert poisson_mix.poisson_mix(no_docs).count() == 0
    zero = spark.createDataFrame([("s0", 0.0), ("s1", None)], "source string, weight double")
    assert poisson_mix.poisson_mix(odd_docs, zero).count() == 0


def test_repeats(odd_docs):
    a = sorted(map(str, poisson_mix.poisson_mix(odd_docs).collect()))
    assert a == sorted(map(str, poisson_mix.poisson_mix(odd_docs.repartition(7)).collect()))


def test_distribution_tail():
    p, cum = math.exp(-poisson_mix.STEP), 0.0
    for k in range(1, poisson_mix.LENGTH + 1):
        cum += p
        p *= poisson_mix.STEP / k
    assert p < 1e-25 and cum == pytest.approx(1)
