"""Best-fit packing by bin completion branch-and-bound.

Documents are cut into pieces of at most ``capacity`` tokens, so a piece is one of ``capacity`` sizes and
the packing depends on the histogram of sizes alone. The solver takes the largest size left and
enumerates fillings of the rest of its sequence, largest sizes first, so that a filling dominated by one
with larger parts comes later and cannot win with equal waste; a branch is cut when even a full use of
what is left cannot beat the incumbent's waste, and the best-fit filling is the first incumbent. The
chosen filling is repeated as often as the counts allow, so the plan has a few thousand entries at any
scale. It is solved on the driver from at most ``capacity`` counts.

Pieces are then given their places without a global sort: a piece's rank within its size is its row
number in a salted bucket plus that bucket's offset; the plan's ranges turn (size, rank) into a sequence
and an offset by binary search.
"""

from __future__ import annotations

import logging
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspan.llm.common import TOKEN_SLICE, column, encode_ids, map_texts, stage_table, tokenizer_path

CAPACITY = 1024
#: Branches looked at for one filling before the incumbent is taken.
EFFORT = 5000
#: Buckets of a length whose sizes are summed in one group.
GROUP = 64


# --- the plan -----------------------------------------------------------------------------------------


def complete(room: int, sizes: np.ndarray, counts: np.ndarray, effort: int = EFFORT, cut: list[int] | None = None) -> list[tuple[int, int]]:
    """The filling of ``room`` with the least waste: (size, copies), sizes falling. ``sizes`` falls
    strictly; counts are what is left of each. A search that ends by its effort notes its room in ``cut``."""
    total_below = np.concatenate((np.cumsum((sizes * counts)[::-1])[::-1], [0]))
    best: list[tuple[int, int]] = []
    best_waste = room
    place = {int(s): i for i, s in enumerate(sizes)}
    left = [effort]

    def branch(at: int, rest: int, chosen: list[tuple[int, int]]) -> bool:
        """True once nothing can be better."""
        nonlocal best, best_waste
        if rest < best_waste:
            best, best_waste = list(chosen), rest
            if rest == 0:
                return True
        # the bound: all that is left cannot bring the waste below the incumbent's
        at = max(at, int(np.searchsorted(-sizes, -rest, "left")))
        if at >= len(sizes) or rest - min(rest, int(total_below[at])) >= best_waste:
            return False
        exact = place.get(rest)
        if exact is not None and exact >= at and counts[exact] > 0:
            # one part of just this size dominates every other way to fill it
            best, best_waste = [*chosen, (rest, 1)], 0
            return True
        for i in range(at, len(sizes)):
            s, n = int(sizes[i]), int(counts[i])
            if not n:
                continue
            if rest - min(rest, int(total_below[i])) >= best_waste:
                return False
            if left[0] <= 0:
                return False
            left[0] -= 1
            for k in range(min(n, rest // s), 0, -1):
                if branch(i + 1, rest - k * s, [*chosen, (s, k)]):
                    return True
                if left[0] <= 0:
                    return False
        return False

    branch(0, room, [])
    if cut is not None and left[0] <= 0 and best_waste:
        cut.append(room)
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY, cut: list[int] | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(size, copies), ...]), ...]: fillings that use up the histogram exactly. ``cut`` takes
    note of the searches that ended by their effort."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        counts[size] = n
    out = []
    while True:
        there = np.flatnonzero(counts)
        if not len(there):
            return out
        top = int(there[-1])
        counts[top] -= 1
        sizes = np.flatnonzero(counts)[::-1]
        sizes = sizes[sizes <= capacity - top]
        fill = complete(capacity - top, sizes, counts[sizes], cut=cut) if len(sizes) else []
        counts[top] += 1
        use = {top: 1}
        for s, k in fill:
            use[s] = use.get(s, 0) + k
        times = int(min(counts[s] // k for s, k in use.items()))
        for s, k in use.items():
            counts[s] -= k * times
        out.append((times, sorted(use.items(), reverse=True)))


class Placement:
    """The plan as ranges: rank r of a size, in the range that starts at ``first``, lies in sequence
    base + (r - first) // copies, at ``offset`` + size * ((r - first) % copies)."""

    def __init__(self, fillings: list[tuple[int, list[tuple[int, int]]]]):
        used: dict[int, int] = {}
        rows, base = [], 0
        for times, parts in fillings:
            at = 0
            for size, copies in parts:
                rows.append((size, used.get(size, 0), base, copies, at))
                used[size] = used.get(size, 0) + times * copies
                at += size * copies
            base += times
        self.sequences = base
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.key = (table[:, 0] << 48) + table[:, 1]
        self.first, self.base, self.copies, self.offset = table[:, 1], table[:, 2], table[:, 3], table[:, 4]

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (size << 48) + rank, "right") - 1
        r = rank - self.first[i]
        return self.base[i] + r // self.copies[i], self.offset[i] + size * (r % self.copies[i])


# --- pieces and places ----------------------------------------------------------------------------------


def token_pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32) of every document's ids with the end id.

    ``row`` tells rows of one doc_id apart in a way that does not depend on partitioning: it is the
    crc32 of all ids, so equal rows are interchangeable.
    """
    path = tokenizer_path()

    def run(part, texts):
        doc, row, piece, start, size, crc = [], [], [], [], [], []
        ids, at = encode_ids(texts, path, end=True)
        raw = memoryview(ids.astype("<u4")).cast("B")
        for doc_id, s, e in zip(column(part, "doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            n = e - s
            whole = zlib.crc32(raw[4 * s : 4 * e])
            cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                doc.append(doc_id)
                row.append(whole)
                piece.append(k)
                start.append(a)
                size.append(b - a)
                crc.append(zlib.crc32(raw[4 * (s + a) : 4 * (s + b)]) if n > capacity else whole)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long", limit=TOKEN_SLICE)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_bucket: int = 20_000) -> DataFrame:
    """``pieces`` (doc_id, row, piece, length and any others) with sequence_id and offset.

    Lengths are 1..capacity. The order of equal lengths is (bucket, doc_id, row, piece), which hashes
    and sorts rows by value, so a task that is run again gives the same places.
    """
    total = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    hist = {r.length: r.n for r in total}
    cut: list[int] = []
    placement = Placement(plan(hist, capacity, cut))
    if cut:
        logging.getLogger(__name__).warning("%d of %d fillings were taken before all branches were seen", len(cut), placement.sequences)
    # several buckets a shuffle partition, so that pieces of one length are spread however many there are
    rows, parts = sum(hist.values()), int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(max(1, min(65_536, max(rows // per_bucket, min(rows // 32, 4 * parts)))))
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "row", "piece"), F.lit(buckets)).cast("int"))
    # what is ahead of a bucket: the groups of GROUP buckets before its own, and the buckets of its own
    sizes = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.floor(F.col("bucket") / GROUP))
    ahead = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("length", "g").agg(F.sum("n").alias("n")).select("length", "g", ahead("n", Window.partitionBy("length").orderBy("g")).alias("base"))
    within = sizes.withColumn("near", ahead("n", Window.partitionBy("length", "g").orderBy("bucket")))
    offsets = within.join(groups, ["length", "g"]).select("length", "bucket", (F.col("base") + F.col("near")).alias("ahead"))
    # merged, never broadcast: the ranked pieces lie as their window left them
    inside = Window.partitionBy("bucket", "length").orderBy("doc_id", "row", "piece")
    ranked = salted.withColumn("nth", F.row_number().over(inside)).join(offsets.hint("merge"), ["length", "bucket"])
    cols = pieces.columns
    sent = pieces.sparkSession.sparkContext.broadcast(placement)  # a few thousand ranges, by the plan
    ranked = ranked.select(*cols, (F.col("ahead") + F.col("nth") - 1).cast("long").alias("rank"))

    def place(batches):
        for b in batches:
            seq, off = sent.value.of(np.asarray(column(b, "length")), np.asarray(column(b, "rank")))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*cols, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text; other columns are not read).

    A null text is empty: its document is the end id alone. Documents longer than ``capacity`` are cut,
    the first piece being the shorter one. Rows that repeat a doc_id are packed each; a null doc_id is
    kept. An empty table gives an empty result.
    """
    pieces = stage_table(token_pieces(docs, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
