import corpus_pipeline as cp
from pyspark.sql import functions as F

from gridspan.llm import centroid_langid, poisson_mix, quality_mil, simhash_vptree
from gridspan.llm.common import DOCUMENT_COLUMNS


def test_stages_do_what_their_operators_decide(spark, documents, labels, sf, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["language_id", "quality", "near_duplicates", "mixing", "packing"]
    docs, seen = documents, []
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        nxt = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert nxt.columns == list(DOCUMENT_COLUMNS)
        seen.append((docs, nxt))
        docs = nxt
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    before, after = seen[0]
    assert ids(before) - ids(after) == ids(centroid_langid.identify_languages(before).filter("rejected"))
    before, after = seen[1]
    assert ids(after) == ids(quality_mil.score_quality(before, labels).filter(F.col("score") >= 0.3))
    before, after = seen[2]
    assert ids(after) == {r.component_id for r in simhash_vptree.near_duplicates(before).collect()}
    before, after = seen[3]
    want = poisson_mix.poisson_mix(before).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == {r.doc_id: r["count"] for r in want}
    before, after = seen[4]
    assert after.filter("piece = 0").count() == before.count()


def test_clean_documents_stay(spark, documents, labels, sf):
    good = documents.join(labels.filter("quality = 1").select("doc_id"), "doc_id").select(*documents.columns)
    kept = cp.quality(spark, cp.language_id(spark, documents, sf), sf)
    lost = good.filter(F.length("text") > 40).join(kept.select("doc_id"), "doc_id", "left_anti").count()
    assert lost <= 0.01 * good.count()


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset", "ids_crc32"} <= set(out.columns)
    assert out.count() > 0


def test_empty_and_odd_tables(spark, documents, odd_docs, sf):
    for docs in (documents.limit(0), odd_docs):
        for i, (_, stage) in enumerate(cp.STAGES):
            got = stage(spark, docs, sf)
            assert got.columns == list(DOCUMENT_COLUMNS) or i == 4
            got.collect()
