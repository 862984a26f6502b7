"""Queries of keyed state and timing in their batch forms (the streams are covered by tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspan.operators import view
from gridspan.plans.registry import Tables, out, query
from gridspan.streaming import views

c = F.col


@query("t03_a22_unlocks", "WITH f AS (SELECT user_id, (props->>'k')::INT AS item, min(event_id) AS e FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e) AS n FROM f) SELECT user_id, e AS event_id FROM r WHERE n = 5")
def t03(t: Tables) -> DataFrame:
    """When each user saw a fifth different item."""
    e = t.events.select("user_id", "event_id", F.from_json("props", "k int")["k"].alias("item"))
    return out(views.unlocks(e, "user_id", "item", ["event_id"]), user_id="long", event_id="long")


@query("t08_link_times", "WITH RECURSIVE q AS (SELECT user_id % 50 AS link, event_id AS id, event_id / 3.0::DOUBLE AS came, (1 + event_id % 40)::DOUBLE AS cost, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS n FROM events), w AS (SELECT *, came AS start, came + cost AS done FROM q WHERE n = 1 UNION ALL SELECT q.*, greatest(q.came, w.done), greatest(q.came, w.done) + q.cost FROM w JOIN q ON q.link = w.link AND q.n = w.n + 1) SELECT link, id, round(start, 4) AS start, round(done, 4) AS done FROM w")
def t08(t: Tables) -> DataFrame:
    """A link that serves requests one after the other: a running maximum, no recurrence."""
    k = c("event_id")
    q = t.events.select((c("user_id") % 50).alias("link"), k.alias("id"), (k / 3.0).alias("at"), ((1 + k % 40) * 10.0).alias("bytes"))
    return out(view.link_times(q, "link", 10.0), link="long", id="long", start="round4", done="round4")


@query("t11_a15_frame_summaries", "WITH s AS (SELECT user_id % 100 AS flight, list(abs(value) ORDER BY abs(value)) AS v FROM events GROUP BY 1) SELECT flight, len(v)::BIGINT AS count, v[least(len(v) - 1, floor(0.5 * len(v))::INT) + 1] AS p50, v[least(len(v) - 1, floor(0.95 * len(v))::INT) + 1] AS p95, v[len(v)] AS longest FROM s")
def t11(t: Tables) -> DataFrame:
    """Middle, 95th and longest frame by index."""
    f = t.events.select((c("user_id") % 100).alias("flight"), F.abs("value").alias("ms"))
    return out(views.frame_summary(f, "flight"), flight="long", count="long", p50="double", p95="double", longest="double")


@query("f22_tasks_in_windows", "WITH t AS (SELECT event_id, event_id * 37.0 AS start, 50 + event_id % 300 AS dur FROM events), w AS (SELECT c_custkey AS id, c_custkey * 211.0 AS t0, c_custkey * 211.0 + 120 + c_custkey % 400 AS t1 FROM customer) SELECT w.id, count(*) AS n, sum(dur)::DOUBLE AS ms FROM t JOIN w ON start + dur >= t0 AND start <= t1 GROUP BY 1")
def f22(t: Tables) -> DataFrame:
    """Long tasks that touch each window."""
    k, u = c("event_id"), c("c_custkey")
    tasks = t.events.select(k, (k * 37.0).alias("start"), (50.0 + k % 300).alias("dur"))
    w = t.customer.select(u.alias("id"), (u * 211.0).alias("t0"), (u * 211.0 + 120 + u % 400).alias("t1"))
    return out(views.overlapping(tasks, w).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("dur").alias("ms")), id="long", n="long", ms="double")


@query("t09_newest_run", "WITH r AS (SELECT user_id, event_id, event_id // 100 AS run FROM events) SELECT user_id, event_id FROM r JOIN (SELECT user_id, max(run) AS run FROM r GROUP BY 1) USING (user_id, run)")
def t09(t: Tables) -> DataFrame:
    """Answers of the newest run; stale ones are dropped."""
    r = t.events.select("user_id", "event_id", F.floor(c("event_id") / 100).alias("run"))
    return out(view.latest_results(r, "user_id"), user_id="long", event_id="long")


@query(
    "t07_stalled_flights",
    """WITH RECURSIVE f AS (SELECT user_id % 100 AS flight, abs(value) / 50 AS ready, row_number() OVER (PARTITION BY user_id % 100 ORDER BY event_id) AS i FROM events),
    walk AS (SELECT flight, 0::BIGINT AS i, 0.0::DOUBLE AS clock, 0.0::DOUBLE AS held FROM (SELECT DISTINCT flight FROM f) UNION ALL
        SELECT flight, i, least(1200.0, clock + CASE WHEN stalled THEN 16.0 * 0.08 ELSE 16.0 END), held + CASE WHEN stalled THEN 16.0 ELSE 0.0 END FROM (SELECT w.flight, f.i, w.clock, w.held, (w.clock / 1200.0 > 0.5 AND f.ready < 0.9 AND w.held < 4000.0) AS stalled FROM walk w JOIN f ON f.flight = w.flight AND f.i = w.i + 1))
    SELECT flight, i, round(clock / 1200.0, 9) AS u FROM walk WHERE i > 0""",
)
def t07(t: Tables) -> DataFrame:
    """Flights that slow down while little is ready."""
    w = Window.partitionBy("flight").orderBy("event_id")
    f = t.events.select((c("user_id") % 100).alias("flight"), "event_id", (F.abs("value") / 50).alias("ready")).withColumn("i", F.row_number().over(w)).select("flight", "i", F.lit(16.0).alias("dt"), F.lit(1200.0).alias("duration"), "ready")
    return out(view.stall_clock(f, "flight"), flight="long", i="long", u="round9")
