"""Language identification by nearest centroid.

A text is lower-cased, everything that is no letter becomes one space, and its byte 2-grams and
3-grams are hashed to ``DIM`` counts; the vector is log(1 + count) * idf, of length 1. Learning takes
two passes: document frequencies of *all* training rows give idf; a bounded sample (``per_lang``
different texts of a language at most, ``sample_rows`` in all) is clustered by spherical k-means into
``clusters`` centroids for each language. A text goes to the centroid of the largest cosine, and is
rejected where its distance exceeds what that centroid's own members showed.

Defined results: a null text, or one without a letter, is ``und``, score 0, rejected. Rows that repeat
an id each get a row. Without any training row every text is ``und``. Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspan.llm.common import column, fold, map_texts, ship, slices

BITS = 12
DIM = 1 << BITS
#: Bytes of a text whose grams are counted at once.
PART = 4 << 20
#: Texts whose counts are held at once: DIM counts of 8 bytes each, 32 MB.
ROWS = 1024
_SPACE = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, DIM) counts of hashed 2- and 3-grams, and whether each text has a letter. A text over
    PART bytes is counted in parts, without the grams across their edges, so memory is bounded."""
    plain = [t.decode("utf-8", "replace").lower() for t in texts]
    letters = np.array([_LETTER.search(t) is not None for t in plain], dtype=bool)
    cleaned = [b" ".join(t.encode().translate(_SPACE).split()) for t in plain]
    if max(map(len, cleaned), default=0) > PART:
        pieces = [[c[k : k + PART] for k in range(0, len(c), PART)] or [b""] for c in cleaned]
        return np.stack([sum(_counts([p])[0] for p in ps) for ps in pieces]), letters
    return _counts(cleaned), letters


def _counts(cleaned: list[bytes]) -> np.ndarray:
    raw = b"\0 " + b" \0 ".join(cleaned) + b" \0\0"
    buf = np.frombuffer(raw, dtype=np.uint8)
    n = len(buf)
    ends = np.flatnonzero(buf == 0)
    size = np.diff(ends)[: len(cleaned)]
    doc = np.repeat(np.arange(len(cleaned), dtype=np.int64) * DIM, size)
    b = buf[: n - 1].astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    with np.errstate(over="ignore"):
        h3 = (((two[:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        h2 = ((two | np.uint32(0xA5000000)) * np.uint32(2246822519)) >> np.uint32(32 - BITS)
    for h, k in ((h2, 2), (h3, 3)):  # a gram across two texts counts in bucket 0, which is unused
        for back in range(k):
            at = ends - back
            at = at[(at >= 0) & (at < len(h))]
            h[at] = 0
    m = min(len(doc), len(h3))
    out = np.bincount(doc[:m] + h3[:m], minlength=len(cleaned) * DIM)[: len(cleaned) * DIM]
    out += np.bincount(doc[:m] + h2[:m], minlength=len(cleaned) * DIM)[: len(cleaned) * DIM]
    out = out.reshape(len(cleaned), DIM)
    out[:, 0] = 0
    return out


@dataclass
class Centroids:
    idf: np.ndarray
    langs: list[str]
    lang_of: np.ndarray
    centre: np.ndarray
    floor: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts, dtype=np.float32) * self.idf
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine in 0..1 and rejected, of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        counts, letters = gram_counts(texts)
        cos = self.vectors(counts) @ self.centre.T
        best = cos.argmax(axis=1)
        score = np.where(letters, np.clip(cos[np.arange(len(texts)), best], 0, 1), 0).astype(np.float64)
        lang = [self.langs[self.lang_of[k]] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return lang, score, ~letters | (score < self.floor[best])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids; starts far apart, so equal inputs give equal results."""
    centre = [x.mean(axis=0)]
    while len(centre) < min(k, len(x)):
        centre.append(x[np.argmin(np.max(x @ np.stack(centre).T, axis=1))])
    c = np.stack(centre)
    for _ in range(rounds):
        to = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[to == j].mean(axis=0) if (to == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def learn(train: DataFrame, clusters: int = 4, per_lang: int = 300, sample_rows: int = 4000, reject_share: float = 0.3) -> Centroids:
    """Centroids of the languages of ``train`` (doc_id, text, lang; lang not null)."""
    spark = train.sparkSession
    ship(spark)

    def frequencies(batches):
        seen, n = np.zeros(DIM, dtype=np.int64), 0
        for _, texts in slices(batches, rows=ROWS):
            seen += (gram_counts(texts)[0] > 0).sum(axis=0)
            n += len(texts)
        seen[0] = n  # bucket 0 is unused: it carries the number of texts
        yield pa.RecordBatch.from_arrays([pa.array([seen.tolist()], pa.list_(pa.int64()))], ["df"])

    parts = train.select("text").mapInArrow(frequencies, "df array<long>")
    rows = parts.select(F.posexplode("df").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("c")).collect()  # DIM rows
    df = np.zeros(DIM)
    for r in rows:
        df[r.k] = r.c
    n = df[0]
    by_lang = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    if not by_lang:
        return Centroids(np.zeros(DIM, np.float32), [], np.zeros(0, int), np.zeros((0, DIM), np.float32), np.zeros(0))
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    idf[0] = 0
    each = max(8, min(per_lang, sample_rows // len(by_lang)))
    # by a hash of the text and not of the id: rows of one id, or without one, are not taken together.
    # Twice the wanted share is drawn; of the different texts drawn those of the least hashes stay.
    keyed = train.select("lang", "text", F.xxhash64("text", F.lit(9)).alias("h"))

    def sample(langs: dict[str, float]) -> DataFrame:
        share = F.broadcast(spark.createDataFrame(list(langs.items()), "lang string, share double"))  # a row for each language
        drawn = keyed.join(share, "lang").filter(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
        nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h"))
        return drawn.groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("nth", nth).filter(F.col("nth") <= each).select("lang", "text")

    def vectors(part, texts):
        counts, letters = gram_counts(texts)
        ok = pa.array(letters)
        data = pa.array([row.astype("<u2").tobytes() for row in np.minimum(counts, 65535)], pa.binary())
        return pa.RecordBatch.from_arrays([column(part, "lang").filter(ok), data.filter(ok)], ["lang", "counts"])

    collect = lambda langs: map_texts(sample(langs), vectors, "lang string, counts binary", rows=ROWS).toPandas()
    got = collect({k: min(1.0, 2 * each / v) for k, v in by_lang.items()})
    if missing := set(by_lang) - set(got["lang"]):  # few different texts, none of them drawn
        got = pd.concat([got, collect({k: 1.0 for k in missing})])
    if got.empty:  # no text has a letter
        return Centroids(idf, [], np.zeros(0, int), np.zeros((0, DIM), np.float32), np.zeros(0))
    model = Centroids(idf, sorted(got["lang"].unique()), np.zeros(0, int), np.zeros((0, DIM), np.float32), np.zeros(0))
    centre, lang_of, floor = [], [], []
    for k, lang in enumerate(model.langs):
        x = model.vectors(np.stack([np.frombuffer(b, dtype="<u2") for b in sorted(got["counts"][got["lang"] == lang])]))
        c = spherical_kmeans(x, clusters)
        cos = x @ c.T
        to = cos.argmax(axis=1)
        low = float(np.quantile(cos.max(axis=1), 0.005))
        for j in range(len(c)):
            mine = cos[to == j, j]
            own = float(np.quantile(mine, 0.005)) if len(mine) >= 20 else low
            centre.append(c[j])
            lang_of.append(k)
            floor.append(reject_share * min(own, low))
    model.centre, model.lang_of, model.floor = np.stack(centre).astype(np.float32), np.array(lang_of), np.array(floor)
    return model


def identify(docs: DataFrame, model: Centroids, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score and rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM * centroids floats
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(part, texts):
        lang, score, rejected = sent.value.predict(texts)
        return pa.RecordBatch.from_arrays([*[column(part, c) for c in keep], pa.array(lang), pa.array(score), pa.array(rejected)], [*keep, "lang_pred", "score", "rejected"])

    return map_texts(docs.select(*dict.fromkeys((*keep, "text"))), run, f"{fields}, lang_pred string, score double, rejected boolean", rows=ROWS)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return fold(doc_id, 3) == 1


def identify_languages(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the training fold of ``docs`` (doc_id, text, lang), then predict every row."""
    model = learn(docs.filter(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    return identify(docs, model, keep)
