"""Token ids as a binary file: static range asymmetric numeral system (rANS).

Ids of all documents, in ascending doc_id order, are cut into blocks of whole documents. One frequency
table, counted over all ids and scaled to 2**``SCALE``, is shared by every block. A block interleaves
``LANES`` coders: id number i goes to lane i mod LANES, all lanes step together (one NumPy operation
each), and share one stream of 32-bit words. So a block is decoded without any other, and from any of
its checkpoints (stream position and all lane states, every ``CHECK_STEPS`` steps) without what comes
before. Checksums: crc32 of the block's bytes, and of the ids.

Block (little-endian): magic ``GRAN``, kind u16 (1: named documents, 2: documents without doc_id), lanes u16, documents u32, steps u32, words u32,
checkpoints u32, ids u64, first id's position u64, crc32 of ids u32, crc32 of the rest of the block u32;
then doc_id i64 and length u32 for each document, checkpoints (position u32, states u64 * lanes; the
first one is the start), and the words u32. A file is a table of blocks (``block`` binary) with a part
for each range of documents, written by Spark's writer, which commits whole files only.

States are below 2**63 and at least 2**31; a step emits one word of a lane at most.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspan.llm.common import MAX_RANGES, TOKEN_SLICE, Ranges, column, encode_ids, map_texts, shared_dir, ship, stage_table, tokenizer_path

SCALE = 18
LANES = 1024
CHECK_STEPS = 256
BLOCK_IDS = 1 << 18
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sHHIIIIQQII")


class Table:
    """Frequencies of the ids, scaled to a sum of 2**SCALE with at least 1 for each id that occurs."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, dtype=np.int64)
        seen = np.flatnonzero(counts)
        freq = np.zeros(len(counts), dtype=np.int64)
        whole = 1 << SCALE
        if len(seen) > whole:
            raise ValueError(f"more than {whole} different ids")
        if len(seen):
            freq[seen] = np.maximum(1, counts[seen] * (whole - len(seen)) // counts.sum())
            freq[seen[np.argmax(counts[seen])]] += whole - freq.sum()
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint16 if len(freq) <= 65536 else np.uint32)

    def __getstate__(self):
        return self.freq

    def __setstate__(self, freq):
        self.freq = freq
        self.cum = np.cumsum(freq, dtype=np.uint64) - freq
        self.symbol = np.repeat(np.arange(len(freq)), freq.astype(np.int64)).astype(np.uint16 if len(freq) <= 65536 else np.uint32)


def encode_block(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, start: int, table: Table) -> bytes:
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, _LOW, dtype=np.uint64)
    freq, cum = table.freq[ids], table.cum[ids]
    if n and not freq.all():
        raise ValueError("an id that the table has not counted")
    words: list[np.ndarray] = [np.empty(0, dtype="<u4")] * steps
    marks: dict[int, np.ndarray] = {}
    up, low32 = np.uint64(63 - SCALE), np.uint64(32)
    for t in range(steps - 1, -1, -1):  # the last id first, so that decoding runs forward
        a, b = t * LANES, min(n, (t + 1) * LANES)
        x, f = state[: b - a], freq[a:b]
        over = x >= f << up
        words[t] = x[over].astype("<u4")
        x = np.where(over, x >> low32, x)
        q, r = np.divmod(x, f)
        state[: b - a] = (q << np.uint64(SCALE)) + r + cum[a:b]
        if t % CHECK_STEPS == 0:
            marks[t] = state.copy()
    sizes = np.cumsum([0, *[len(w) for w in words]])
    kind = 2 if len(doc_ids) and doc_ids[0] is None else 1
    body = [np.asarray([0] * len(doc_ids) if kind == 2 else doc_ids, dtype="<i8").tobytes(), np.asarray(lengths, dtype="<u4").tobytes()]
    for t in sorted(marks):
        body += [struct.pack("<I", int(sizes[t])), marks[t].astype("<u8").tobytes()]
    body += [w.tobytes() for w in words]
    rest = b"".join(body)
    return _HEAD.pack(b"GRAN", kind, LANES, len(doc_ids), steps, int(sizes[-1]), len(marks), n, start, zlib.crc32(np.asarray(ids, dtype="<u4").tobytes()), zlib.crc32(rest)) + rest


def block_head(block: bytes) -> dict:
    """Header, doc_ids, lengths and checkpoints; the checksum of the block is tested."""
    magic, kind, lanes, docs, steps, n_words, marks, n, start, ids_crc, crc = _HEAD.unpack_from(block)
    if magic != b"GRAN" or kind not in (1, 2):
        raise ValueError("not a block of this format")
    if zlib.crc32(memoryview(block)[_HEAD.size :]) != crc:
        raise ValueError("a block's bytes do not match its checksum")
    at = _HEAD.size
    doc_ids = np.frombuffer(block, "<i8", docs, at)
    lengths = np.frombuffer(block, "<u4", docs, at + 8 * docs).astype(np.int64)
    at += 12 * docs
    points = []
    for _ in range(marks):
        points.append((struct.unpack_from("<I", block, at)[0], np.frombuffer(block, "<u8", lanes, at + 4)))
        at += 4 + 8 * lanes
    words = np.frombuffer(block, "<u4", n_words, at)
    return {"kind": kind, "lanes": lanes, "steps": steps, "n": n, "start": start, "ids_crc": ids_crc, "doc_ids": doc_ids, "lengths": lengths, "points": points, "words": words}


def decode_steps(head: dict, table: Table, point: int) -> np.ndarray:
    """The ids from one checkpoint to the next; needs nothing that comes before it."""
    lanes, n = head["lanes"], head["n"]
    first, stop = point * CHECK_STEPS, min(head["steps"], (point + 1) * CHECK_STEPS)
    position, state = head["points"][point]
    state = state.astype(np.uint64)
    words = head["words"].astype(np.uint64)
    out = np.empty(min(n, stop * lanes) - first * lanes, dtype=np.uint32)
    mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for t in range(first, stop):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        x = state[: b - a]
        slot = x & mask
        ids = table.symbol[slot]
        out[a - first * lanes : b - first * lanes] = ids
        x = table.freq[ids] * (x >> scale) + slot - table.cum[ids]
        under = np.flatnonzero(x < _LOW)
        x[under] = (x[under] << np.uint64(32)) | words[position : position + len(under)]
        position += len(under)
        state[: b - a] = x
    return out


def decode_block(block: bytes, table: Table) -> tuple[dict, np.ndarray]:
    head = block_head(block)
    parts = [decode_steps(head, table, k) for k in range(len(head["points"]))]
    ids = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != head["ids_crc"]:
        raise ValueError("decoded ids do not match their checksum")
    return head, ids


# --- tables -------------------------------------------------------------------------------------------


def tokenized(docs: DataFrame, ranges: Ranges) -> DataFrame:
    """(doc_id, h, ids, bucket): ids with the end id, as little-endian unsigned 16-bit integers, a hash
    of the text, and the range of ids; rows without doc_id are in the last."""
    path = tokenizer_path()

    def run(part, texts):
        ids, at = encode_ids(texts, path, end=True)
        offsets, values = pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))
        h = np.asarray(column(part, "h"))
        bucket = ranges.number(np.asarray(column(part, "doc_id").fill_null(2**63 - 1)), h)
        return pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(h), pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, values]), pa.array(bucket, pa.int64())], ["doc_id", "h", "ids", "bucket"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text"), run, "doc_id long, h long, ids binary, bucket long", limit=TOKEN_SLICE)


def count_ids(table: DataFrame) -> np.ndarray:
    """Occurrences of every id over all rows (no null ids): partial counts by task, then by id."""

    def run(batches):
        counts = np.zeros(1 << 16, dtype=np.int64)
        for b in batches:
            col = column(b, "ids")  # its values lie in one buffer
            ends = np.frombuffer(col.buffers()[1], dtype=np.int32 if pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1]
            counts += np.bincount(np.frombuffer(col.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view("<u2"), minlength=1 << 16)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["id", "n"])

    out = np.zeros(1 << 16, dtype=np.int64)
    for r in table.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():  # at most 65,536 rows
        out[r.id] = r.n
    return out


def write_binary(docs: DataFrame, path: str, block_ids: int = BLOCK_IDS, per_bucket: int = 4000) -> Table:
    """Write the ids of ``docs`` (doc_id, text) at ``path`` and return the shared table, which is
    written at ``path``/table as well.

    Defined results: a null text is empty (the end id alone). Rows that repeat a doc_id stay apart, in
    the order of a hash of their texts. Rows without doc_id come after all others, in that order, in
    blocks of their own kind, and are read back without one. An empty table writes no block. A document
    longer than a block has a block of its own.
    """
    spark = docs.sparkSession
    ship(spark)
    ranges = Ranges.of(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("key")), "key", per_bucket)
    # as many partitions as ranges, so that a task's share does not grow with the table
    dealt = tokenized(docs, ranges).repartition(min(ranges.n, MAX_RANGES), "bucket")
    # each document's first position in its range goes along, so that the table may be read in any split
    ahead_of = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_last(), "h", "ids").rowsBetween(Window.unboundedPreceding, -1)
    placed = F.coalesce(F.sum((F.octet_length("ids") / 2).cast("long")).over(ahead_of), F.lit(0).cast("long"))
    ids = stage_table(dealt.select("doc_id", "ids", "bucket", placed.alias("pos")), "token-ids", "lz4")
    table = Table(count_ids(ids))
    sizes = ids.groupBy("bucket").agg(F.sum(F.octet_length("ids") / 2).cast("long").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = {r.bucket: r.ahead for r in sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")).collect()}
    sent, ahead = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(starts)  # 2**16 frequencies; a number for each range

    def run(batches):
        held: list[tuple[int, bytes]] = []
        first, after = 0, None

        def block():
            raw = np.frombuffer(b"".join(r for _, r in held), dtype="<u2")
            data = encode_block(raw, [d for d, _ in held], [len(r) // 2 for _, r in held], first, sent.value)
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([held[0][0]], pa.int64()), pa.array([data], pa.binary())], ["start", "first_doc", "block"])

        for b in batches:
            for bucket, pos, doc_id, raw in zip(*(column(b, c).to_pylist() for c in ("bucket", "pos", "doc_id", "ids")), strict=True):
                at = ahead.value[bucket] + pos
                if held and (at != after or (doc_id is None) != (held[-1][0] is None) or at + len(raw) // 2 - first > block_ids):
                    yield block()
                    held = []
                if not held:
                    first = at
                held.append((doc_id, raw))
                after = at + len(raw) // 2
        if held:
            yield block()

    ids.mapInArrow(run, "start long, first_doc long, block binary").write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(table.freq.astype("<u4").tobytes()),)], "freq binary").write.parquet(f"{path}/table")
    return table


def read_table(spark: SparkSession, path: str) -> Table:
    table = Table.__new__(Table)
    table.__setstate__(np.frombuffer(bytes(spark.read.parquet(f"{path}/table").first().freq), dtype="<u4").astype(np.uint64))
    return table


def read_binary(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded block by block."""
    ship(spark)
    sent = spark.sparkContext.broadcast(read_table(spark, path))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        for b in batches:
            for block in column(b, "block"):
                head, ids = decode_block(block.as_py(), sent.value)
                ends = np.cumsum(head["lengths"])
                starts = ends - head["lengths"]
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                names = pa.nulls(len(starts), pa.int64()) if head["kind"] == 2 else pa.array(head["doc_ids"], pa.int64())
                cols = [names, pa.array(starts + head["start"], pa.int64()), pa.array(head["lengths"], pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    return spark.read.parquet(f"{path}/blocks").select("block").mapInArrow(run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to the shared folder and read back (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    write_binary(docs, path)
    return read_binary(spark, path)
