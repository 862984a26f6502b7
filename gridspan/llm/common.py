"""Helpers shared by the training-data operators.

* ``stage_table`` cuts lineage: it writes a table to the shared folder that the cluster names in
  ``spark.checkpoint.dir`` and reads it back, so a lost executor costs a re-read, not a recompute.
* ``TextBlock`` holds a bounded slice of documents as one byte buffer and finds words, lines and
  64-bit hashes of any byte span with a few NumPy passes instead of a Python loop per word.
* ``WordTable`` gives token ids by the ``tokenizers`` library, remembering words it has seen.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspan.session import ship  # noqa: F401

#: Bytes of text handled at once inside a Python worker (a longer document is a slice of its own).
SLICE_BYTES = 1 << 20
SLICE_ROWS = 8192
#: Boundaries of ranges of ids, which go to all tasks, at most; beyond as many ranges grow.
MAX_RANGES = 10_000
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


# --- tables ----------------------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a local session has a temporary one; on a cluster
    that is an error, since executors would not share it."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    kept = getattr(spark.sparkContext, "_gridspan_shared", None)
    if kept is None:
        kept = spark.sparkContext._gridspan_shared = "file://" + tempfile.mkdtemp(prefix="gridspan-")
    return kept


def stage_table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key of more rows than this is hot where it also has more than 1 / HOT_KEYS of all rows.
HOT_ROWS, HOT_KEYS = 4096, 100_000


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join (inner or left) of ``left``, a stage table, with ``right``, whose keys are unique.

    Rows of hot keys would meet in one task. They stay where they are, and the right side's rows of these
    keys, fewer than HOT_KEYS by the definition of hot, are broadcast; all other rows are joined by shuffle.
    """
    least = max(HOT_ROWS, left.count() // HOT_KEYS)
    hot = stage_table(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > least).select(*keys), "hot-keys")
    if hot.isEmpty():
        return left.join(right, keys, how)
    few = right.join(F.broadcast(hot), keys, "left_semi")
    stay = left.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(few), keys, how)
    return stay.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))


def fold(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id is in fold 0 of its own crc (of '')."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(mod).cast("bigint"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled training rows of each class.

    Ids are taken in the order of a hash, so the sample does not depend on partitioning. Only ids are
    ordered; the texts are fetched by a join whose small side holds 2 * per_class ids. Of the rows that
    repeat an id, the one whose text has the least hash is taken, so the bound holds whatever repeats;
    rows without an id have no label.
    """
    ids = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    ids = ids.filter(train).dropDuplicates(["doc_id"])
    keyed = ids.withColumn("h", F.xxhash64(F.col("doc_id")))
    taken = None
    for value in (0, 1):
        part = keyed.filter(F.col("label") == value).orderBy("h", "doc_id").limit(per_class).drop("h")
        taken = part if taken is None else taken.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")  # at most 2 * per_class rows
    return found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")).select("doc_id", "m.text", "label")


class Ranges:
    """Ranges of a long key, in rising order, of about ``per_bucket`` rows each.

    Their boundaries are percentiles over all rows, at most MAX_RANGES. A key that several percentiles
    fall on has more rows than a range should: it is a range of its own, split on by a second hash, so
    rows of one repeated (or missing) id do not meet in one task unless their texts are equal too.
    """

    def __init__(self, cuts: list[int], times: dict[int, int]):
        self.cuts = np.array(sorted({*cuts, *times, *(v + 1 for v in times if v < 2**63 - 1)}), dtype=np.int64)
        self.times = np.ones(len(self.cuts) + 1, dtype=np.int64)
        for v, k in times.items():
            self.times[np.searchsorted(self.cuts, v, "right")] = k
        self.base = np.cumsum(self.times) - self.times

    @property
    def n(self) -> int:
        return int(self.times.sum())

    @classmethod
    def of(cls, rows: DataFrame, key: str, per_bucket: int) -> Ranges:
        parts = max(1, min(MAX_RANGES, -(-rows.count() // per_bucket)))
        if parts == 1:
            return cls([], {})
        share = [i / parts for i in range(1, parts)]
        got = Counter(rows.select(F.percentile_approx(key, share, max(10_000, 20 * parts)).alias("q")).first()["q"])
        return cls(list(got), {v: k + 1 for v, k in got.items() if k > 1})

    def number(self, key: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The range of each key, those of one hot key in the order of the hash."""
        r = np.searchsorted(self.cuts, key, "right")
        top = (h.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        return self.base[r] + (top.astype(np.int64) * self.times[r] >> 32)

    def column(self, key: str, h: str) -> Column:
        """``number`` as a Column; only the two longs go through Python."""
        ranges = self

        @F.pandas_udf("int")
        def place(k: pd.Series, v: pd.Series) -> pd.Series:
            return pd.Series(ranges.number(k.to_numpy(), v.to_numpy()).astype(np.int32))

        return place(key, h)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text and at most ``rows`` rows, and the texts as UTF-8 (null: empty)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            col = col.cast(pa.large_binary())
        n = len(col)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            stop = min(stop, n, at + rows)
            yield batch.slice(at, stop - at), [x or b"" for x in col.slice(at, stop - at).to_pylist()]
            at = stop


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch | None], schema: str | T.StructType, text: str = "text", limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` over bounded slices: fn(slice, texts) -> RecordBatch of ``schema``."""

    ship(df.sparkSession)

    def run(batches):
        for part, texts in slices(batches, text, limit, rows):
            out = fn(part, texts)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


# --- byte-level text -------------------------------------------------------------------------------

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The inverse of _ODD modulo 2**64.
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_POWERS: dict[str, np.ndarray] = {}
#: Bytes whose prefix sums are held at once.
HASH_STEP = 1 << 21


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        with np.errstate(over="ignore"):
            for k, base in (("p", _ODD), ("i", _INV)):
                a = np.full(size, base, dtype=np.uint64)
                a[0] = 1
                _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["i"][:n]


class TextBlock:
    """Texts joined by line feeds in one buffer. A text is bytes [start[d], end[d])."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.n = len(texts)
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        ws = _WS[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], ws)).astype(np.int8)))
        self.ws = ws
        self.word_start, self.word_end = edge[0::2], edge[1::2]
        self.word_doc = np.searchsorted(self.end, self.word_start, "right")
        self.n_words = np.bincount(self.word_doc, minlength=self.n).astype(np.int64)
        self.first_word = np.concatenate(([0], np.cumsum(self.n_words)))

    def hashes(self, start: np.ndarray, end: np.ndarray, buf: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the byte spans [start, end), both rising: a polynomial by prefix sums, then
        mixed. The sums are made for HASH_STEP bytes at a time, so a very long text needs no more memory
        than a short one but for its spans."""
        buf = self.buf if buf is None else buf
        n = len(buf)
        p, inv = _powers(min(n, HASH_STEP) + 1)
        low, high, scale = (np.empty(len(start), dtype=np.uint64) for _ in range(3))
        carry = np.uint64(0)
        with np.errstate(over="ignore"):
            for o in range(0, n + 1, HASH_STEP):
                part = buf[o : o + HASH_STEP]
                sums = np.empty(len(part) + 1, dtype=np.uint64)
                sums[0] = carry
                up = np.uint64(pow(int(_ODD), o, 1 << 64))
                np.cumsum(_BYTE[part] * (p[: len(part)] * up if o else p[: len(part)]), out=sums[1:])
                sums[1:] += carry
                carry = sums[-1]
                for at, out in ((start, low), (end, high)):
                    i, j = np.searchsorted(at, (o, o + HASH_STEP), "left")
                    out[i:j] = sums[at[i:j] - o]
                    if out is low:
                        scale[i:j] = inv[at[i:j] - o] * np.uint64(pow(int(_INV), o, 1 << 64))
            return mix((high - low) * scale ^ mix((end - start).astype(np.uint64), 3))

    def chained(self, word_hash: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences [first, stop), from the words' hashes."""
        p, inv = _powers(len(word_hash) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word_hash * p[: len(word_hash)], dtype=np.uint64)))
            return mix((sums[stop] - sums[first]) * inv[first] ^ mix((stop - first).astype(np.uint64), 5))

    @staticmethod
    def bit_sums(doc: np.ndarray, n: int, wide: np.ndarray, step: int = 1 << 17) -> np.ndarray:
        """(n, bits): how many of each text's rows of ``wide`` (rows, words of 64 bits) have each bit;
        ``doc`` rises. A bounded number of rows is spread to bits at once."""
        out = np.zeros((n, 64 * wide.shape[1]), dtype=np.int64)
        for lo in range(0, len(doc), step):
            d = doc[lo : lo + step]
            bits = np.unpackbits(wide[lo : lo + step].astype(">u8").view(np.uint8).reshape(len(d), -1), axis=1)
            first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            out[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        return out

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every line (split at line feeds)."""
        end = np.flatnonzero(self.buf == 10)
        start = np.concatenate(([0], end[:-1] + 1))
        return start, end, np.searchsorted(self.end, start, "left")


# --- token ids -------------------------------------------------------------------------------------

#: The end id that the packing and binary operators append to each document.
END_ID = 2
_TABLES: dict[str, WordTable] = {}
#: Words that a Python worker remembers: about 50 bytes each, with their place in the hash table.
TABLE_WORDS = 1 << 20
#: Bytes of text that are tokenized at once.
TOKEN_SLICE = 3 << 19

def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordTable:
    """Ids of words, by the ``tokenizers`` library, remembered in an open-addressing table of NumPy arrays.

    A text is cut where the byte-level pre-tokenizer always cuts: before a single space that a visible
    character follows, around a lone line feed, and between an ASCII letter and a comma or full stop.
    So the ids of the pieces joined are those of ``Tokenizer.encode(text, add_special_tokens=False)``.
    Pieces are known by two 64-bit hashes of their bytes. Only a piece not met before goes to the
    library, many at once in one text, whose ids are parted by the bytes that each token stands for.
    A full table is emptied, so memory is bounded.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tk.get_added_tokens_decoder().values()]
        vocab = self.tk.get_vocab(with_added_tokens=True)
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("ids are held in 16 bits")
        self.size = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.size[i] = len(token)  # of a byte-level token: one character stands for one byte
        self.slots = 2 * TABLE_WORDS
        self.clear()

    @classmethod
    def at(cls, path: str) -> WordTable:
        if path not in _TABLES:
            _TABLES[path] = cls(path)
        return _TABLES[path]

    def clear(self) -> None:
        self.key = np.zeros(self.slots, dtype=np.uint64)
        self.entry = np.zeros(self.slots, dtype=np.int32)
        self.n = 1  # entry 0 is the end id
        self.check = np.zeros(1024, dtype=np.uint64)
        self.start = np.zeros(1024, dtype=np.int64)
        self.count = np.ones(1024, dtype=np.int64)
        self.pool = np.full(4096, END_ID, dtype=np.uint16)
        self.used = 1

    def encode(self, texts: list[bytes], end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (uint16), and the first id's place of each text and of the end. ``end``:
        END_ID after each text."""
        raw = b"".join(texts)
        odd: dict[int, bytes] = {}
        if any(s in raw for s in self.special):  # a text that holds a special token's string goes whole
            odd = {i: t for i, t in enumerate(texts) if any(s in t for s in self.special)}
            texts = [b"" if i in odd else t for i, t in enumerate(texts)]
            raw = b"".join(texts)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        stop = np.cumsum(size)
        first = _piece_starts(raw, stop - size, size)
        entries = self._entries(raw, first, np.diff(np.append(first, len(raw))))
        doc = np.searchsorted(stop, first, "right")
        if end:
            entries = np.concatenate((entries, np.zeros(len(texts), dtype=np.int64)))
            doc = np.concatenate((doc, np.arange(len(texts))))
            order = np.argsort(doc, kind="stable")
            entries, doc = entries[order], doc[order]
        count = self.count[entries]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(self.start[entries] - (ends - count), count)
        ids = self.pool[place]
        per = np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(per)))
        if odd:
            parts = [ids[at[i] : at[i + 1]] for i in range(len(texts))]
            for i, t in odd.items():
                parts[i] = np.concatenate((np.array(self.tk.encode(t.decode(), add_special_tokens=False).ids, dtype=np.uint16), parts[i]))
            ids, at = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, at

    def _entries(self, raw: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        if self.n > TABLE_WORDS or self.n + len(first) > 0.9 * self.slots:
            self.slots = 2 * max(TABLE_WORDS, 1 << len(first).bit_length())
            self.clear()
        h, check = _piece_hashes(raw, first, size)
        found = self._find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            _, at, back = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[at]
            ids = self._add(raw, first[at], size[at], h[at], check[at])
            found[new] = ids[back]
        wrong = np.flatnonzero(self.check[found] != check)
        if len(wrong):  # two pieces with one hash: the second is kept apart
            for i in wrong.tolist():
                found[i] = self._add(raw, first[[i]], size[[i]], None, check[[i]])[0]
        return found

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.slots - 1)
        out = np.full(len(h), -1, dtype=np.int64)
        rows, at = np.arange(len(h)), (h & mask).astype(np.int64)
        while len(rows):
            k = self.key[at]
            hit = k == h[rows]
            out[rows[hit]] = self.entry[at[hit]]
            go = ~hit & (k != 0)
            rows, at = rows[go], (at[go] + 1) & (self.slots - 1)
        return out

    def _add(self, raw: bytes, first: np.ndarray, size: np.ndarray, h: np.ndarray | None, check: np.ndarray) -> np.ndarray:
        """Encode pieces and remember them; their entries."""
        begin, stop = first.tolist(), (first + size).tolist()
        pieces = [raw[a:b] for a, b in zip(begin, stop, strict=True)]
        count = np.zeros(len(pieces), dtype=np.int64)
        got: list[np.ndarray] = [np.empty(0, np.uint16)] * 0
        order: list[int] = []
        space = [i for i, p in enumerate(pieces) if p[:1] == b" "]
        rest = [i for i, p in enumerate(pieces) if p[:1] != b" "]
        plain, alone = [], []
        for i in rest:
            t = pieces[i].decode()
            (alone if t[0].isspace() or t[-1].isspace() else plain).append(i)
        for group, between in ((space, b""), (plain, b"\n")):
            for k in range(0, len(group), 2048):
                part = group[k : k + 2048]
                ids = np.array(self.tk.encode_batch_fast([between.join([pieces[i] for i in part]).decode()], add_special_tokens=False)[0].ids, dtype=np.uint16)
                ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(size[part] + len(between)), "right")
                ends[-1] = len(ids) + len(between)
                count[part] = np.diff(np.append(0, ends)) - len(between)
                if between:  # the line feeds between are tokens of their own
                    keep = np.ones(len(ids), dtype=bool)
                    keep[ends[:-1] - 1] = False
                    ids = ids[keep]
                got.append(ids)
                order += part
        for i in alone:
            ids = np.array(self.tk.encode(pieces[i].decode(), add_special_tokens=False).ids, dtype=np.uint16)
            count[i] = len(ids)
            got.append(ids)
            order.append(i)
        flat = np.concatenate(got) if got else np.empty(0, np.uint16)
        start = np.zeros(len(pieces), dtype=np.int64)
        start[order] = self.used + np.cumsum(count[order]) - count[order]
        self.pool = _grown(self.pool, self.used + len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        entry = np.arange(self.n, self.n + len(pieces))
        for name, values in (("check", check), ("start", start), ("count", count)):
            held = _grown(getattr(self, name), self.n + len(pieces))
            held[entry] = values
            setattr(self, name, held)
        self.n += len(pieces)
        if h is not None:
            rows, at = np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
            while len(rows):
                free = self.key[at] == 0
                self.key[at[free]] = h[rows[free]]  # of two that meet in a free slot one stays
                mine = free & (self.key[at] == h[rows])
                self.entry[at[mine]] = entry[rows[mine]]
                rows, at = rows[~mine], (at[~mine] + 1) & (self.slots - 1)
        return entry


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), dtype=a.dtype)
    out[: len(a)] = a
    return out


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: A byte that surely begins a visible character: no control, no white space, and not the first byte of
#: the multi-byte white space characters.
_VISIBLE = np.ones(256, dtype=bool)
_VISIBLE[[*range(0x21), 0x7F, *range(0x80, 0xC0), 0xC2, 0xE1, 0xE2, 0xE3]] = False


def _piece_starts(raw: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where pieces begin; each text with bytes begins one."""
    buf = np.frombuffer(raw, dtype=np.uint8)
    n = len(buf)
    if not n:
        return np.empty(0, dtype=np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    inside = np.ones(n + 1, dtype=bool)  # not the first byte of a text
    inside[first[size > 0]] = False
    inside[n] = False
    nxt = np.flatnonzero(buf[:-1] == 32)
    cut[nxt[_VISIBLE[buf[nxt + 1]] & inside[nxt + 1]]] = True
    mark = np.flatnonzero((buf[1:] == 44) | (buf[1:] == 46)) + 1
    cut[mark[_LETTER[buf[mark - 1]]]] = True
    feed = np.flatnonzero(buf[1:-1] == 10) + 1
    seen = (buf[feed - 1] > 32) & (buf[feed - 1] < 127)
    feed = feed[seen & _VISIBLE[buf[feed + 1]] & inside[feed] & inside[feed + 1]]
    cut[feed] = True
    cut[feed + 1] = True
    cut[first[size > 0]] = True
    return np.flatnonzero(cut[:n])


def _piece_hashes(raw: bytes, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each piece, never 0, by eight bytes at a time."""
    padded = raw + bytes(8)
    words = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    with np.errstate(over="ignore"):
        a = mix(size.astype(np.uint64), 31)
        b = mix(size.astype(np.uint64), 32)
        rows, at, left = np.arange(len(first)), first, size
        while len(rows):
            w = words[at]
            short = left < 8
            w = np.where(short, w & ((np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)), w)
            x = (a[rows] ^ w) * np.uint64(0xBF58476D1CE4E5B9)
            a[rows] = x ^ (x >> np.uint64(29))
            y = (b[rows] + w) * np.uint64(0x94D049BB133111EB)
            b[rows] = y ^ (y >> np.uint64(32))
            go = left > 8
            rows, at, left = rows[go], at[go] + 8, left[go] - 8
        return mix(a, 33) | np.uint64(1), mix(b, 34)


def encode_ids(texts: list[bytes], path: str, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids (uint16) of UTF-8 texts one after the other, and where each text's begin; see WordTable."""
    return WordTable.at(path).encode(texts, end)
