"""Quality rules by cross-document line frequency.

Lines are normalised (ASCII lower case, digits as 0, white space runs as one space) and hashed to 64
bits; for every host the distinct documents that hold a line are counted. A document is a doc_id: rows
that repeat an id count once, and a row without an id is known by its text. Lines in more than
``min_docs`` documents of a host, and in more than ``share`` of its documents, are removed there, and a
document that this depletes (under ``min_words`` words left, or under ``min_left`` of its words) is
rejected. Base rules on the document alone go before. So copies of one text are boilerplate like any
other where they are that large a part of a host.

The count is of distinct (host, line, document) rows, so a line that a third of all documents hold is
spread over all partitions and then summed in part before the shuffle. Joins on a line or on a text go
by ``skew_join``, which takes the keys of very many rows apart.

Defined results: a null text has no word and fails the base rules; a null host is a host of its own;
repeated rows each get a row; other columns are not read, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspan.llm.common import TextBlock, column, map_texts, mix, skew_join, stage_table

_NORMAL = bytes(ord("0") if 48 <= b < 58 else b + 32 if 65 <= b < 91 else b for b in range(256))
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 8
#: Production limits.
MIN_DOCS, SHARE, MIN_WORDS, MIN_LEFT = 64, 0.01, 20, 0.3


def measure(texts: list[bytes]) -> dict[str, np.ndarray | list]:
    """The base counts of each text, a hash of it, and its different lines with their words."""
    b = TextBlock(texts)
    doc_salt = mix(np.arange(b.n, dtype=np.uint64), 21)
    out: dict = {"n_words": b.n_words}
    first, last = np.concatenate(([0], b.end[:-1] + 1)), b.end

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return (sums[last] - sums[first]).astype(np.int64)

    out["word_chars"] = per_text(~b.ws & ((b.buf & 0xC0) != 0x80))
    out["n_symbols"] = per_text(_SYMBOL[b.buf])
    out["text_hash"] = b.hashes(b.start, b.end).view(np.int64)
    # lines with a word
    start, end, line_doc = b.lines()
    word_line = np.searchsorted(end, b.word_start, "right")
    words = np.bincount(word_line, minlength=len(end))
    at = np.flatnonzero(words)
    raw = b.hashes(start[at], end[at]) ^ doc_salt[line_doc[at]]
    distinct = np.unique(raw, return_index=True)[1]
    lines, apart = np.bincount(line_doc[at], minlength=b.n), np.bincount(line_doc[at[distinct]], minlength=b.n)
    out["n_dup_lines"] = (lines - apart).astype(np.int64)
    # words in windows found twice
    h = b.hashes(b.word_start, b.word_end)
    n_repeat = np.zeros(b.n, dtype=np.int64)
    k = np.arange(max(0, len(h) - WINDOW + 1))
    k = k[b.word_doc[k] == b.word_doc[k + WINDOW - 1]] if len(k) else k
    if len(k):
        w = b.chained(h, k, k + WINDOW) ^ doc_salt[b.word_doc[k]]
        order = np.argsort(w)
        same = w[order[1:]] == w[order[:-1]]
        twice = np.zeros(len(k), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(cover, k[twice], 1)
        np.add.at(cover, k[twice] + WINDOW, -1)
        n_repeat = np.bincount(b.word_doc[np.cumsum(cover)[:-1] > 0], minlength=b.n).astype(np.int64)
    out["n_repeat_words"] = n_repeat
    # normalised lines, each once in a text, with all words that it takes there
    low = b.hashes(b.word_start, b.word_end, np.frombuffer(b.raw.translate(_NORMAL), dtype=np.uint8))
    stop = np.cumsum(words)[at]
    norm = b.chained(low, stop - words[at], stop)
    d = line_doc[at]
    order = np.lexsort((norm, d))
    norm, d, n = norm[order], d[order], words[at][order]
    new = np.concatenate(([True], (norm[1:] != norm[:-1]) | (d[1:] != d[:-1]))) if len(norm) else np.zeros(0, bool)
    cut = np.flatnonzero(new)
    out["line_hash"] = norm[cut].view(np.int64)
    out["line_words"] = (np.add.reduceat(n, cut) if len(cut) else n).astype(np.int64)
    out["line_offsets"] = np.concatenate(([0], np.cumsum(np.bincount(d[cut], minlength=b.n)))).astype(np.int32)
    return out


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash"]


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and what ``measure`` finds, of every row."""

    def run(part, texts):
        m = measure(texts)
        off = pa.array(m["line_offsets"], pa.int32())
        lists = [pa.ListArray.from_arrays(off, pa.array(m[c], pa.int64())) for c in ("line_hash", "line_words")]
        return pa.RecordBatch.from_arrays([column(part, "doc_id").cast(pa.int64()), column(part, "host"), *[pa.array(m[c], pa.int64()) for c in _COUNTS], *lists], ["doc_id", "host", *_COUNTS, "line_hash", "line_words"])

    return map_texts(docs.select("doc_id", "text", F.col(host).cast("string").alias("host")), run, f"doc_id long, host string, {', '.join(c + ' long' for c in _COUNTS)}, line_hash array<long>, line_words array<long>")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _host_key() -> Column:
    return F.when(F.col("host").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "host")).alias("host_key")


def _doc() -> tuple[Column, Column]:
    """A document: its id, or without one its text."""
    return F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", "text_hash").alias("doc")


def lines_of(table: DataFrame) -> DataFrame:
    """(host_key, text_hash, line, words): the lines of different texts."""
    pair = F.explode(F.arrays_zip("line_hash", "line_words")).alias("l")
    return table.select("host_key", "text_hash", pair).select("host_key", "text_hash", F.col("l.line_hash").alias("line"), F.col("l.line_words").alias("words")).groupBy("host_key", "text_hash", "line").agg(F.max("words").alias("words"))


def frequent_lines(table: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host_key, line, n_docs) of the lines above both limits. ``table``: (host_key, doc_id, text_hash,
    line_hash) of every row."""
    held = table.select("host_key", *_doc(), F.explode("line_hash").alias("line")).distinct()
    counts = held.groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > min_docs)
    hosts = table.select("host_key", *_doc()).distinct().groupBy("host_key").agg(F.count(F.lit(1)).alias("host_docs"))
    return counts.join(hosts, "host_key").filter(F.col("n_docs") > share * F.col("host_docs")).select("host_key", "line", "n_docs")


def _removed(table: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host_key, text_hash, line, words): the frequent lines of each different text."""
    frequent = stage_table(frequent_lines(table, min_docs, share), "frequent-lines")
    return skew_join(stage_table(lines_of(table), "lines"), frequent.select("host_key", "line"), ["host_key", "line"])


def rule_documents(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT) -> DataFrame:
    """A row for each row of ``docs``: doc_id, the counts, removed_words, base_failed and kept."""
    table = stage_table(measured(docs, host).select(_host_key(), "doc_id", *_COUNTS, "line_hash", "line_words"), "lines-measured")
    removed = _removed(table, min_docs, share).groupBy("host_key", "text_hash").agg(F.sum("words").alias("removed_words"))
    out = skew_join(table.drop("line_hash", "line_words"), removed, ["host_key", "text_hash"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < min_words) | (left < min_left * F.col("n_words")))
    return out.select("doc_id", *_COUNTS[:-1], "removed_words", base_failed().alias("base_failed"), (~base_failed() & ~depleted).alias("kept"))


def strip_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """The columns of ``docs`` with the frequent lines of each text taken out. A text without any
    stays byte for byte; a null text stays null. A row travels as one struct, so no column's name can
    clash with those used here."""
    table = stage_table(measured(docs, host).select(_host_key(), "doc_id", "text_hash", "line_hash", "line_words"), "lines-measured")
    drop = _removed(table, min_docs, share).groupBy("host_key", "text_hash").agg(F.collect_set("line").alias("gone"))  # at most a text's own lines
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), "text", F.col(host).cast("string").alias("host"))

    def hashed(part, texts):
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(measure(texts)["text_hash"], pa.int64())], [*part.schema.names, "text_hash"])

    with_hash = map_texts(rows, hashed, T.StructType([*rows.schema.fields, T.StructField("text_hash", T.LongType())]))
    joined = skew_join(stage_table(with_hash.select("row", "text", _host_key(), "text_hash"), "lines-hashed"), drop, ["host_key", "text_hash"], "left")

    def cut(part, texts):
        out = []
        for raw, null, gone in zip(texts, column(part, "text").is_null().to_pylist(), column(part, "gone").to_pylist(), strict=True):
            if null or not gone:
                out.append(None if null else raw)
                continue
            rows = raw.split(b"\n")
            m = measure(rows)  # a row's one line, if it has words
            at = m["line_offsets"]
            found = np.zeros(len(rows), dtype=bool)
            some = np.flatnonzero(np.diff(at))
            found[some] = np.isin(m["line_hash"][at[some]], np.array(gone, dtype=np.int64))
            out.append(b"\n".join(row for row, f in zip(rows, found.tolist(), strict=True) if not f))
        return pa.RecordBatch.from_arrays([column(part, "row"), pa.array(out, pa.binary()).cast(pa.string())], ["row", "text"])

    done = map_texts(joined.select("row", "text", "gone"), cut, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
    return done.select(*[(F.col("text") if n == "text" else F.col("row").getField(n)).alias(n) for n in docs.columns])
