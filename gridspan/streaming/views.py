"""Keyed state over event streams: the distinct-view unlock, and chunk states with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

c = F.col
NEEDED = 5


def unlocks(events: DataFrame, user: str, item: str, order: list[str], needed: int = NEEDED) -> DataFrame:
    """(user, order): batch form. When each user saw the ``needed``-th different item."""
    first = Window.partitionBy(user, item).orderBy(*order)
    d = events.withColumn("_f", F.row_number().over(first)).filter("_f = 1")
    return d.withColumn("_n", F.row_number().over(Window.partitionBy(user).orderBy(*order))).filter(c("_n") == needed).select(user, *order)


def unlock_stream(events: DataFrame, user: str, item: str, needed: int = NEEDED) -> DataFrame:
    """(user, items): a row once a user of the stream has seen ``needed`` different items. The state of a
    user is at most ``needed`` items; those unlocked keep a mark alone and never fire again."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, fired = state.get if state.exists else ([], False)
        seen = list(seen)
        for b in batches:
            if fired:
                continue
            for v in b[item].astype(str):
                if v not in seen:
                    seen.append(v)
                if len(seen) >= needed:
                    fired = True
                    yield pd.DataFrame({user: [key[0]], "items": [",".join(sorted(seen))]})
                    break
        state.update(([] if fired else seen, fired))

    kind = events.schema[user].dataType.simpleString()
    return events.groupBy(user).applyInPandasWithState(step, f"`{user}` {kind}, items string", "seen array<string>, fired boolean", "append", GroupStateTimeout.NoTimeout)


def chunk_state_stream(events: DataFrame, session: str, retry_ms: int = 3000) -> DataFrame:
    """(session, chunk, action): what to do with wanted chunks of a session. Events are (session, chunk,
    kind: want / built / failed / drop, ms). A wanted chunk is requested unless it is built, under way,
    or failed less than ``retry_ms`` ago; failures expire, so state holds live chunks alone."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []
        for b in batches:
            for r in b.sort_values("ms").itertuples():
                now = held.get(r.chunk)
                if now is not None and now.startswith("failed:") and r.ms - int(now[7:]) >= retry_ms:
                    now = None
                    held.pop(r.chunk)
                if r.kind == "want" and now is None:
                    held[r.chunk] = "pending"
                    out.append((key[0], r.chunk, "request"))
                elif r.kind == "built":
                    held[r.chunk] = "built"
                elif r.kind == "failed":
                    held[r.chunk] = f"failed:{r.ms}"
                elif r.kind == "drop" and now is not None:
                    held.pop(r.chunk)
                    out.append((key[0], r.chunk, "cancel" if now == "pending" else "evict"))
        state.update((list(held), list(held.values())))
        if out:
            yield pd.DataFrame(out, columns=[session, "chunk", "action"])

    kind = events.schema[session].dataType.simpleString()
    return events.groupBy(session).applyInPandasWithState(step, f"`{session}` {kind}, chunk string, action string", "chunks array<string>, states array<string>", "append", GroupStateTimeout.NoTimeout)


def overlapping(tasks: DataFrame, windows: DataFrame, slot: float = 1000.0) -> DataFrame:
    """Tasks (start, dur) that touch windows (id, t0, t1): both are exploded to time slots, which makes an
    equi-join; the exact test follows."""
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / slot), F.floor(b / slot)))
    t = tasks.withColumn("slot", spread(c("start"), c("start") + c("dur")))
    w = windows.withColumn("slot", spread(c("t0"), c("t1")))
    d = t.join(w, "slot").filter((c("start") + c("dur") >= c("t0")) & (c("start") <= c("t1")))
    # a pair that shares several slots counts in the first of them
    return d.filter(c("slot") == F.greatest(F.floor(c("start") / slot), F.floor(c("t0") / slot))).drop("slot")


def frame_summary(frames: DataFrame, by: str) -> DataFrame:
    """(by, count, p50, p95, longest) of frame times."""
    from gridspan.operators.view import index_percentile

    return frames.groupBy(by).agg(F.count(F.lit(1)).alias("count"), index_percentile(c("ms"), 0.5).alias("p50"), index_percentile(c("ms"), 0.95).alias("p95"), F.max("ms").alias("longest"))
