"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs: its lines, a long line being cut on at content-defined words, so
that an edit changes only the pieces it touches. Every piece is hashed to a wide vector, and a text's
fingerprint is the sum of its pieces' vectors, lane by lane modulo a power of two:

* ``SIGNS`` lanes of +1 or -1, modulo 2**32, and
* ``WORDS`` lanes of 64 uniform bits, modulo 2**64, against accidental equality.

Sums do not depend on order, and a piece is inserted or deleted by adding or subtracting its vector,
without the rest of the text. The sign lanes of two texts have an inner product whose mean is the
product of their multisets, so 2 <a, b> / (<a, a> + <b, b>) estimates their likeness (the standard
error is below 1 / sqrt(SIGNS)); equal texts have 1 exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.llm.common import SLICE_BYTES, Ranges, TextBlock, column, mix, ship

SIGNS, WORDS = 192, 2
HEX = SIGNS * 8 + WORDS * 16
#: A word ends a piece if its hash has these bits clear: four words a piece on average.
CUT_MASK = np.uint64(3)


class Fingerprints:
    """Fingerprints of some texts: ``signs`` (n, SIGNS) int64 modulo 2**32, ``words`` (n, WORDS)."""

    def __init__(self, signs: np.ndarray, words: np.ndarray):
        self.signs, self.words = (signs + 2**31) % 2**32 - 2**31, words

    @classmethod
    def of(cls, texts: list[bytes]) -> Fingerprints:
        b = TextBlock(texts)
        start, doc = _pieces(b)
        stop = np.where(np.append(doc[1:] == doc[:-1], False), np.append(start[1:], 0), b.end[doc]) if len(start) else start
        h = b.hashes(start, stop)
        wide = np.stack([mix(h, 100 + k) for k in range(SIGNS // 64)], axis=1) if len(h) else np.zeros((0, SIGNS // 64), np.uint64)
        words = np.zeros((b.n, WORDS), dtype=np.uint64)
        n = np.bincount(doc, minlength=b.n)
        signs = 2 * b.bit_sums(doc, b.n, wide) - n[:, None]
        base = np.cumsum(n) - n
        at = np.flatnonzero(n)
        if len(at):
            for k in range(WORDS):
                words[at, k] = np.add.reduceat(mix(h, 200 + k), base[at])
        return cls(signs, words)

    def __add__(self, other: Fingerprints) -> Fingerprints:
        """Insert the pieces of the other texts, row by row."""
        with np.errstate(over="ignore"):
            return Fingerprints(self.signs + other.signs, self.words + other.words)

    def __sub__(self, other: Fingerprints) -> Fingerprints:
        """Delete the pieces of the other texts, row by row."""
        with np.errstate(over="ignore"):
            return Fingerprints(self.signs - other.signs, self.words - other.words)

    def __getitem__(self, rows) -> Fingerprints:
        return Fingerprints(self.signs[rows], self.words[rows])

    def hex(self) -> list[str]:
        raw = np.concatenate([(self.signs % 2**32).astype(">u4").view(np.uint8), self.words.astype(">u8").view(np.uint8)], axis=1)
        return [r.tobytes().hex() for r in raw]

    @classmethod
    def from_hex(cls, values: list[str]) -> Fingerprints:
        raw = np.frombuffer(bytes.fromhex("".join(values)), dtype=np.uint8).reshape(len(values), -1)
        return cls(raw[:, : 4 * SIGNS].copy().view(">u4").astype(np.int64), raw[:, 4 * SIGNS :].copy().view(">u8").astype(np.uint64))

    def likeness(self, other: Fingerprints) -> np.ndarray:
        """0..1, row by row; 1 exactly for equal fingerprints, those of empty texts included."""
        a, b = self.signs.astype(float), other.signs.astype(float)
        size = (a * a).sum(axis=1) + (b * b).sum(axis=1)
        same = (a == b).all(axis=1) & (self.words == other.words).all(axis=1)
        like = np.clip(2 * (a * b).sum(axis=1) / np.maximum(size, 1), 0, 1)
        return np.where(same, 1.0, np.minimum(like, np.nextafter(1, 0)))


def _pieces(b: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and text of every piece; pieces cover a text, white space included."""
    h = b.hashes(b.word_start, b.word_end)
    feeds = np.concatenate(([0], np.cumsum(b.buf == 10)))
    begins = np.ones(len(h), dtype=bool)  # a word begins a piece after a cut, a line feed or another text
    if len(h) > 1:
        begins[1:] = ((h[:-1] >> np.uint64(20)) & CUT_MASK == 0) | (feeds[b.word_start[1:]] != feeds[b.word_end[:-1]])
    k = np.flatnonzero(begins)
    start, doc = b.word_start[k], b.word_doc[k]
    if len(k):
        head = np.concatenate(([True], doc[1:] != doc[:-1]))
        start = np.where(head, b.start[doc], start)  # white space before the first word
    bare = np.flatnonzero((b.n_words == 0) & (b.end > b.start))  # white space only: one piece
    if len(bare):
        start, doc = np.concatenate((start, b.start[bare])), np.concatenate((doc, bare))
        order = np.argsort(doc, kind="stable")
        start, doc = start[order], doc[order]
    return start, doc


def fingerprint_pairs(docs: DataFrame, per_bucket: int = 4000) -> DataFrame:
    """Each document with its edited text: the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document's, in descending doc_id (after the last: the first).

    Texts move once: documents are dealt to ranges of about ``per_bucket`` ids and sorted there; the
    last of a range finds the next in a guest row, a copy of the first row of the range below.

    Null texts count as empty. Null ids come after all others. Rows of one id are ordered by a hash of
    their texts; however many there are, one row at most is a guest. A single document is its own next.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key")).withColumn("h", F.xxhash64("text"))
    ranges = Ranges.of(rows, "key", per_bucket)
    rows = rows.withColumn("bucket", ranges.column("key", "h") if ranges.n > 1 else F.lit(0))
    heads = {r.bucket: (r.head.key, r.head.h) for r in rows.groupBy("bucket").agg(F.max(F.struct("key", "h")).alias("head")).collect()}  # a row for each range
    there = sorted(heads)
    # the guest of a range is the first row of the next range below, of the lowest that of the highest
    to = [(*heads[there[i - 1]], b) for i, b in enumerate(there)]
    own = rows.withColumn("guest", F.lit(False))
    parts = max(1, len(there))
    if to:
        small = F.broadcast(spark.createDataFrame(to, "key long, h long, home int"))  # a row for each range
        guests = rows.drop("bucket").join(small, ["key", "h"]).dropDuplicates(["home"]).select("doc_id", "text", "key", "h", F.col("home").alias("bucket"), F.lit(True).alias("guest"))
        own = own.unionByName(guests)
    number = F.create_map(*[F.lit(v) for i, b in enumerate(there) for v in (b, i)]) if len(there) != ranges.n and there else None
    place = F.col("bucket") if number is None else number[F.col("bucket")]
    dealt = own.repartitionById(parts, place).sortWithinPartitions(F.col("bucket"), F.col("guest"), F.col("key").desc(), F.col("h").desc(), F.col("text"))

    def run(batches):
        held: list[tuple] = []  # rows whose next is not seen yet, all but the last having it
        size = 0
        for batch in batches:
            for doc_id, text, guest in zip(*(column(batch, n).to_pylist() for n in ("doc_id", "text", "guest")), strict=True):
                held.append((doc_id, text))
                size += len(text)
                if guest:
                    if len(held) > 1:
                        yield _paired(held)
                    held, size = [], 0
                elif size > SLICE_BYTES:
                    yield _paired(held)
                    held, size = held[-1:], len(text)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _paired(held: list[tuple]) -> pa.RecordBatch:
    ids, texts = [h[0] for h in held[:-1]], [h[1] for h in held]
    n = [len(t) for t in texts[:-1]]
    edited = [t[: k - k // 2] + after[: k // 2] for t, after, k in zip(texts, texts[1:], n, strict=False)]
    raw = [e.encode("utf-8", "surrogatepass") for e in edited]
    mine, other = Fingerprints.of([t.encode("utf-8", "surrogatepass") for t in texts]), Fingerprints.of(raw)
    now, after = mine[:-1], mine[1:]
    data = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in raw]), pa.array(now.hex()), pa.array(other.hex()), pa.array(now.likeness(other)), pa.array(now.likeness(after))]
    return pa.RecordBatch.from_arrays(data, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
