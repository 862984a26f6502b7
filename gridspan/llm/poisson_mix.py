"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only.

Source s with n_s documents and target weight w_s gets the mean repetition rate
rate_s = total * w_s / (sum of w) / n_s. A document's count is a Poisson variable of that mean: the
inverse of its distribution at u, a uniform number from a hash of (seed, doc_id). So counts do not
depend on partitioning, repeat on a lost task, and have the right mean for every source without any
communication between documents. Rates above ``STEP`` are split into equal parts, each with its own u
(sums of Poisson variables are Poisson), so a table of the distribution has a fixed length. Each
document is exploded by its count and the copies are shuffled globally by a second hash.

The rates, a row for each source, are written and read back, so that Spark knows their size: it
broadcasts them below its own threshold and shuffles (splitting a hot source) above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.llm.common import stage_table

#: Largest mean drawn at once, and the length of its distribution's table (tail below 1e-25).
STEP, LENGTH = 64.0, 200
#: Columns that the operator adds; incoming columns of these names are replaced.
ADDED = ("copy", "n_copies", "shuffle_key")


def source_rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, temperature: float = 0.5) -> DataFrame:
    """(key, rate): the mean repetitions of every source in ``docs``.

    ``weights``: (source, weight); a source without one, or with a null or negative one, gets none.
    None: the weight is n_s ** temperature. ``total``: expected rows, by default as many as ``docs``.
    A null source is a source of its own (the key is null).
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("_w"))
        weighed = counts.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "n", F.greatest(F.coalesce("_w", F.lit(0.0)), F.lit(0.0)).alias("w"))
    weighed = stage_table(weighed, "weights")
    sums = weighed.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()  # two numbers
    all_w, rows = sums.w or 1.0, float(total if total is not None else sums.n or 0)
    return weighed.select("source", (F.col("w") / F.lit(all_w) * F.lit(rows) / F.col("n")).alias("rate"))


def distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. LENGTH of a Poisson variable, by the recurrence of its terms."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def add(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + p).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LENGTH)), start, add, lambda acc: acc["c"])


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 48 bits from md5 of the parts, joined by "|"."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: int = 17, temperature: float = 0.5) -> DataFrame:
    """The rows of ``docs``, each as often as its count says, with copy (from 1), n_copies and
    shuffle_key, in the order of shuffle_key within every partition.

    Rows of one doc_id get the same count; a null doc_id hashes as an empty one. Null texts and other
    columns go along untouched. An empty table, or weights of 0, gives an empty result.
    """
    names = [c for c in docs.columns if c not in ADDED]
    rates = source_rates(docs, weights, total, temperature)
    parts = F.ceil(F.col("rate") / F.lit(STEP)).cast("int")
    table = stage_table(rates.filter("rate > 0").select(F.col("source").alias("_source"), parts.alias("_parts"), distribution(F.col("rate") / parts).alias("_cdf")), "rates")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # a plain equi-join on an always present key: a hot source can be split, a null one is kept
    named = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c))
    table = table.select(named(F.col("_source")).alias("_key"), "_parts", "_cdf")
    drawn = docs.select(*names, named(F.col("source")).alias("_key")).join(table, "_key").withColumn("_id", key)
    # the numbers first: an expression within the filter would hash again for every entry of the table
    numbers = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda i: uniform(F.lit(str(seed)), F.col("_id"), i.cast("string")))
    count = F.aggregate(numbers, F.lit(0), lambda acc, u: acc + F.size(F.filter("_cdf", lambda c: c <= u)))
    copies = drawn.select(*names, "_id", count.alias("n_copies")).filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    shuffled = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}s"), F.col("_id"), F.col("copy").cast("string")))).drop("_id")
    return shuffled.select(*names, *ADDED).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def oracle_sql(seed: int = 17) -> str:
    """DuckDB SQL of the query: temperature 0.5, as many rows expected as there are."""
    return f"""
    WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    sums AS (SELECT sum(pow(n::DOUBLE, 0.5)) AS w, sum(n)::DOUBLE AS n FROM counts),
    rates AS (SELECT c.source, pow(c.n::DOUBLE, 0.5) / s.w * s.n / c.n AS rate FROM counts c, sums s),
    split AS (SELECT source, ceil(rate / {STEP})::INT AS parts, rate / ceil(rate / {STEP}) AS m FROM rates WHERE rate > 0),
    terms AS (
      SELECT source, parts, m, 0 AS k, exp(-m) AS p, exp(-m) AS c FROM split
      UNION ALL
      SELECT source, parts, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM terms WHERE k < {LENGTH}
    ),
    cdf AS (SELECT source, parts, list(c ORDER BY k) AS cdf FROM terms GROUP BY source, parts),
    drawn AS (
      SELECT d.*, u.i, CAST('0x' || substr(md5('{seed}|' || coalesce(d.doc_id::VARCHAR, '') || '|' || u.i), 1, 12) AS BIGINT)::DOUBLE / {float(1 << 48)} AS u, cdf
      FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source, unnest(range(1, parts + 1)) AS u(i)
    ),
    counted AS (SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cdf, lambda c: c <= u)))::INT AS n_copies FROM drawn GROUP BY ALL HAVING n_copies > 0)
    SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, n_copies, md5('{seed}s|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS shuffle_key
    FROM counted, unnest(range(1, n_copies + 1)) AS t(copy)"""
