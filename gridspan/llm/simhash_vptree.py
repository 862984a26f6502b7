"""SimHash near-duplicate links by vantage-point trees.

Fingerprint. A text's A-Z are lower-cased; its words are runs of bytes other than space and
0x09-0x0D; a shingle is three words joined by spaces (fewer words: all of them; none: fingerprint
0). A bit is 1 where over half of the shingles' XXH64 (seed 42) have it, repeats included.

Links. Two fingerprints link at ``radius`` or fewer differing bits. Fingerprints of unrelated texts lie
32 bits apart with a deviation of 4, so in the whole metric a radius of 3 is most of the spread and the
triangle bound prunes little. Of two linked codes, though, either the low halves differ in at most
(radius - 1) // 2 bits or the high halves in at most the rest of radius - 1 (one bit each for radius
3). So there are two vantage-point trees, each over all fingerprints in the Hamming metric of one half
with that smaller radius rho, and every link is found in one of them or both.

* A tree's upper part is learned on the driver from a bounded sample: a node has a vantage point v and
  a radius mu, and parts codes by d(x, v) <= mu. Its leaves are *shards* of about ``shard_rows`` codes.
* Every code has one home shard. By the triangle bound it can link to a code inside only if
  d(x, v) <= mu + rho, and to one outside only if d(x, v) > mu - rho; those just outside a boundary are
  also sent inside, as *queries* of the shards on that side. Shards that the bound rules out are pruned.
* A shard's task builds the tree on over its home codes, down to leaves that are compared exactly, and
  searches it for the home codes and then for the queries, which stream past in batches.

Shards give no list of pairs, but a spanning forest of the links they found (fewer edges than
fingerprints); components are then joined across shards by star contraction. Only the sample (SAMPLE
codes a shard, MAX_SHARDS shards at most; with more codes shards grow) and counts go to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspan.llm.common import TextBlock, column, map_texts, stage_table

LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def fingerprints_of(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints of UTF-8 texts."""
    import xxhash

    block = TextBlock([t.translate(LOWER) for t in texts])
    # one space between words: a copy without the other white space, in which a shingle is a slice
    size = block.word_end - block.word_start
    keep = ~block.ws
    keep[block.word_end[block.word_end < len(keep)]] = True
    packed = np.where(block.ws, np.uint8(0x20), block.buf)[keep].tobytes()
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    out = np.zeros(block.n, dtype=np.uint64)
    n_sh = np.where(block.n_words >= shingle, block.n_words - shingle + 1, np.minimum(block.n_words, 1))
    doc = np.repeat(np.arange(block.n), n_sh)
    if len(doc):
        base = np.concatenate(([0], np.cumsum(n_sh)))[:-1]
        first = block.first_word[doc] + np.arange(len(doc)) - base[doc]
        last = np.minimum(first + shingle, block.first_word[doc + 1]) - 1
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(packed[a:b], 42) for a, b in zip(start[first].tolist(), stop[last].tolist(), strict=True)), dtype=np.uint64, count=len(doc))
        ones = block.bit_sums(doc, block.n, hashes[:, None])
        out[:] = np.packbits(2 * ones > n_sh[:, None], axis=1).view(">u8").ravel()
    return out


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long: the 64 bits as a signed integer). A null text has no word: fingerprint 0."""

    def run(part, texts):
        return pa.RecordBatch.from_arrays([column(part, "doc_id").cast(pa.int64()), pa.array(fingerprints_of(texts).view(np.int64))], ["doc_id", "fp"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, fp long")


# --- metrics and trees ----------------------------------------------------------------------------------

LOW_HALF, HIGH_HALF, WHOLE = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF << 32), np.uint64(2**64 - 1)
#: Codes of a shard's sample, and the most shards a tree has.
SAMPLE, MAX_SHARDS = 256, 1 << 14
#: A split that sends more than this share to one side is none.
POOR = 0.9


def distance(codes: np.ndarray, v, mask) -> np.ndarray:
    return np.bitwise_count((codes ^ v) & mask).astype(np.int64)


@dataclass
class Node:
    """Codes with d(x, v) <= mu under ``mask`` are near, the others far; links there have d <= rho."""

    v: np.uint64
    mask: np.uint64
    rho: int
    mu: int
    near: Node | int
    far: Node | int


def metrics(radius: int) -> list[tuple[np.uint64, int]]:
    """The half metrics of the two trees: of each the mask and the largest distance of what it must find."""
    low = (radius - 1) // 2
    return [(LOW_HALF, low), (HIGH_HALF, radius - 1 - low)]


def choose(sample: np.ndarray, ways: list[tuple[np.uint64, int]], tries: int) -> tuple[float, tuple] | None:
    """The vantage point, metric and mu that leave the smaller larger side, boundary included."""
    best = None
    for v in sample[:: max(1, len(sample) // tries)][:tries]:
        for mask, rho in ways:
            n = np.cumsum(np.bincount(distance(sample, v, mask), minlength=66)) / len(sample)
            mu = np.arange(64)
            worst = np.maximum(n[np.minimum(mu + rho, 65)], 1 - n[mu])
            worst[(n[mu] == 0) | (n[mu] == 1)] = 1
            k = int(worst.argmin())
            if worst[k] < 1 and (best is None or worst[k] < best[0]):
                best = (float(worst[k]), (v, mask, rho, k))
    return best


def ways_of(mask: np.uint64, rho: int, radius: int) -> list[list[tuple[np.uint64, int]]]:
    """A tree's own metric; and where that does not part a family of codes, the others, whose bound is
    the whole radius."""
    return [[(mask, rho)], [(~mask & WHOLE, radius), (WHOLE, radius)]]


def plan_shards(sample: np.ndarray, rows: int, shard_rows: int, mask: np.uint64, rho: int, radius: int, first: int = 0) -> tuple[Node | int, int]:
    """The upper part of a tree, its leaves numbered from ``first`` on, and the next number."""
    if rows > shard_rows and len(sample) >= 16:
        for ways in ways_of(mask, rho, radius):
            found = choose(sample, ways, 8)
            if found is not None and found[0] <= POOR:
                v, m, r, mu = found[1]
                inside = distance(sample, v, m) <= mu
                near, nxt = plan_shards(sample[inside], int(rows * inside.mean()), shard_rows, mask, rho, radius, first)
                far, nxt = plan_shards(sample[~inside], int(rows * (~inside).mean()), shard_rows, mask, rho, radius, nxt)
                return Node(v, m, r, mu, near, far), nxt
    return first, first + 1


def route(root: Node | int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, query): the home shard of every code, and the shards that it must query."""
    rows, shards, queries = [], [], []
    stack = [(root, np.arange(len(codes)), np.zeros(len(codes), dtype=bool))]
    while stack:
        node, at, query = stack.pop()
        if not len(at):
            continue
        if not isinstance(node, Node):
            rows.append(at)
            shards.append(np.full(len(at), node, dtype=np.int32))
            queries.append(query)
            continue
        d = distance(codes[at], node.v, node.mask)
        # home codes go to their side, those outside but near the boundary query the inside as well
        near = d <= node.mu + node.rho
        stack.append((node.near, at[near], query[near] | (d[near] > node.mu)))
        far = d > np.where(query, node.mu - node.rho, node.mu)
        stack.append((node.far, at[far], query[far]))
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(rows), np.concatenate(shards), np.concatenate(queries)) if rows else (none, none.astype(np.int32), none.astype(bool))


class Forest:
    """Spanning edges of the links met: union-find over codes by index."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a) > 256:  # many links between few components: one of each pair of components
            root = self.parent
            while (root[root] != root).any():
                root = root[root]
            self.parent = root.copy()
            p, q = root[a], root[b]
            key = np.minimum(p, q) * np.int64(len(root)) + np.maximum(p, q)
            _, at = np.unique(np.where(p == q, -1, key), return_index=True)
            a, b = a[at], b[at]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self._find(x), self._find(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.edges.append((x, y))


class VPTree:
    """A vantage-point tree over distinct 64-bit codes, of one metric."""

    LEAF = 128
    #: Code pairs compared at once.
    PAIRS = 1 << 20

    def __init__(self, codes: np.ndarray, mask: np.uint64, rho: int, radius: int):
        self.codes, self.radius = codes, radius
        self.ways = ways_of(mask, rho, radius)
        self.splits = 0
        #: Branches that queries went into, those that the bound spared them, and pairs compared.
        self.followed, self.pruned, self.compared = 0, 0, 0
        self.leaves: list[np.ndarray] = []
        self.root = self._build(np.arange(len(codes)))

    def _build(self, rows: np.ndarray) -> Node | int:
        if len(rows) > self.LEAF:
            for ways in self.ways:
                found = choose(self.codes[rows[:: max(1, len(rows) // 256)]], ways, 2)
                if found is None or found[0] > POOR:
                    continue
                v, mask, rho, mu = found[1]
                inside = distance(self.codes[rows], v, mask) <= mu
                if inside.all() or not inside.any():
                    continue
                self.splits += 1
                return Node(v, mask, rho, mu, self._build(rows[inside]), self._build(rows[~inside]))
        self.leaves.append(rows)
        return len(self.leaves) - 1

    def search(self, queries: np.ndarray, found, own: bool = False) -> None:
        """found(query index, code index) for all pairs within the radius. ``own``: the queries are the
        tree's codes, and each pair is met once."""
        stack = [(self.root, np.arange(len(queries)), np.zeros(len(queries), dtype=bool) if own else np.ones(len(queries), dtype=bool))]
        while stack:
            node, at, foreign = stack.pop()
            if not len(at):
                continue
            if not isinstance(node, Node):
                leaf = self.leaves[node]
                self.compared += len(leaf) * len(at)
                step = max(1, self.PAIRS // max(1, len(leaf)))
                for k in range(0, len(at), step):
                    part = at[k : k + step]
                    near = np.bitwise_count(queries[part][:, None] ^ self.codes[leaf][None, :]) <= self.radius
                    if own:
                        near &= foreign[k : k + step][:, None] | (part[:, None] < leaf[None, :])
                    i, j = np.nonzero(near)
                    if len(i):
                        found(part[i], leaf[j])
                continue
            d = distance(queries[at], node.v, node.mask)
            near = d <= node.mu + node.rho
            stack.append((node.near, at[near], foreign[near] | (d[near] > node.mu)))
            far = d > np.where(foreign, node.mu - node.rho, node.mu)
            stack.append((node.far, at[far], foreign[far]))
            went = int(near.sum() + far.sum())
            self.followed, self.pruned = self.followed + went, self.pruned + 2 * len(at) - went

    def linked(self) -> Forest:
        """The forest of the tree's own codes."""
        forest = Forest(len(self.codes))
        self.search(self.codes, forest.unite, own=True)
        return forest


class Shard:
    """A shard's search: home codes first, then any number of batches of queries."""

    def __init__(self, tree: int, codes: np.ndarray, rep: np.ndarray, radius: int):
        self.rep = rep
        self.tree = VPTree(codes, *metrics(radius)[tree], radius)
        self.parent = None

    def edges(self, queries: np.ndarray | None = None, rep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.rep)
        if queries is None:
            forest, names = self.tree.linked(), self.rep
        else:
            forest, names = Forest(n + len(queries)), np.concatenate((self.rep, rep))
            forest.parent[:n] = self.parent
            self.tree.search(queries, lambda q, x: forest.unite(q + n, x))
        root = forest.parent
        while (root[root] != root).any():
            root = root[root]
        self.parent = root[:n]  # roots are the least index, and home codes come first
        a, b = np.array(forest.edges, dtype=np.int64).reshape(-1, 2).T
        return names[a], names[b]


# --- the forest ----------------------------------------------------------------------------------------


def plan_trees(fps: DataFrame, radius: int, shard_rows: int, n: int) -> list[Node | int]:
    """The upper parts of the two trees. The sample is drawn by a hash of the code."""
    shard_rows = max(shard_rows, -(-n // MAX_SHARDS))
    if n <= shard_rows:
        return [0, 1]
    share = min(1.0, SAMPLE * max(4, 2 * n // shard_rows) / n)
    drawn = fps.filter(F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20))).select("fp").toPandas()["fp"]
    sample = np.sort(drawn.to_numpy(dtype=np.int64)).view(np.uint64)
    out, first = [], 0
    for mask, rho in metrics(radius):
        root, first = plan_shards(sample, n, shard_rows, mask, rho, radius, first)
        out.append(root)
    return out


def shards_of(root: Node | int) -> int:
    """The last shard's number."""
    while isinstance(root, Node):
        root = root.far
    return root


def dealt(fps: DataFrame, trees: list[Node | int]) -> DataFrame:
    """(tree, shard, fp, rep, query): every fingerprint's home shards and those that it queries."""
    sent = fps.sparkSession.sparkContext.broadcast(trees)  # at most 2 * MAX_SHARDS nodes

    def place(batches):
        for b in batches:
            fp, rep = np.asarray(column(b, "fp")), np.asarray(column(b, "rep"))
            for k, root in enumerate(sent.value):
                rows, shard, query = route(root, fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, dtype=np.int32)), pa.array(shard), pa.array(fp[rows]), pa.array(rep[rows]), pa.array(query)], ["tree", "shard", "fp", "rep", "query"])

    return fps.select("fp", "rep").mapInArrow(place, "tree int, shard int, fp long, rep long, query boolean")


def links(fps: DataFrame, radius: int = 3, shard_rows: int = 4096, n: int | None = None) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints linked, directly or by others. ``fps``: (fp,
    rep), distinct fp."""
    if radius < 1:
        return fps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).filter("false")
    trees = plan_trees(fps, radius, shard_rows, fps.count() if n is None else n)
    parts = min(10_000, shards_of(trees[-1]) + 1)
    by_shard = dealt(fps, trees).repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "query", "fp")

    def search(batches):
        """Shards come one after the other, in each the home codes before the queries."""
        number, home, shard = None, [], None
        for b in batches:
            cols = [np.asarray(column(b, n)) for n in ("shard", "tree", "fp", "rep")] + [np.asarray(column(b, "query").cast(pa.int8()))]
            cuts = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[4]) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                s, tree, query = int(cols[0][lo]), int(cols[1][lo]), bool(cols[4][lo])
                fp, rep = cols[2][lo:hi].view(np.uint64), cols[3][lo:hi]
                if s != number:
                    if home:
                        yield _record(_shard_of(home).edges())
                    number, home, shard = s, [], None
                if not query:
                    home.append((tree, fp, rep))
                    continue
                if home:
                    shard, home = _shard_of(home), []
                    yield _record(shard.edges())
                if shard is not None:  # a shard without home codes has nothing to find
                    yield _record(shard.edges(fp, rep))
        if home:
            yield _record(_shard_of(home).edges())

    def _shard_of(home):
        return Shard(home[0][0], np.concatenate([h[1] for h in home]), np.concatenate([h[2] for h in home]), radius)

    def _record(pair):
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in pair], ["a", "b"])

    return by_shard.mapInArrow(search, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])).filter("a != b").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and two sums that tell one set of edges from another."""
    h = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), h(1), h(2)).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, by alternating star contraction.

    Every round's edges are written to the shared folder. Rounds grow with the logarithm of the
    longest chain; running out of rounds is an error, never a partial answer.
    """
    now = stage_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        # large star: every neighbour of x that is larger than x goes to the least neighbour (or x)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of x, and x, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        after = stage_table(small, "edges")
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = 3, shard_rows: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text; other columns are
    not read).

    Empty and null texts have fingerprint 0 and link like any other. Rows that repeat a doc_id each
    give a row. A row whose doc_id is null cannot be named: it keeps its fingerprint, links to
    nothing and has a null component. An empty table gives an empty result.
    """
    table = stage_table(fingerprint_table(docs), "fingerprints")
    distinct = stage_table(table.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    # distinct fingerprints of one rep (repeated doc_ids) are one node: their rows share the id
    comp = components(links(distinct, radius, shard_rows))
    # of texts whose fingerprint links to none, the component is the smallest id with that fingerprint
    named = distinct.join(comp, distinct["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = table.join(named, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, radius: int = 3, shard_rows: int = 4096) -> DataFrame:
    """The rows of ``docs`` less near duplicates: of each component of fingerprints the row with the
    smallest doc_id stays (of repeated rows of that id and fingerprint, one, chosen by a hash of its
    values). Texts under one doc_id that do not link are apart. Rows with a null doc_id all stay."""
    table = stage_table(fingerprint_table(docs).filter("doc_id IS NOT NULL"), "fingerprints")
    distinct = stage_table(table.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    comp = components(links(distinct.select("fp", F.col("fp").alias("rep")), radius, shard_rows))
    named = distinct.join(comp, distinct["fp"] == comp["node"], "left").groupBy(F.coalesce("component", "fp").alias("component"))
    found = named.agg(F.min(F.struct("doc_id", "fp")).alias("head")).select("head.doc_id", F.col("head.fp").alias("_fp"))
    cols = docs.columns
    by, rows = ["doc_id"], docs
    if not table.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").isEmpty():
        by, rows = ["doc_id", "_fp"], _with_fingerprints(docs)  # an id alone does not tell the text
    order = F.xxhash64("text", *[f.name for f in docs.schema.fields if f.name != "text" and "map<" not in f.dataType.simpleString()])
    kept = rows.join(found.select(*by), by, "left_semi").groupBy(*by).agg(F.min_by(F.struct(*cols), order).alias("_row"))
    return kept.select("_row.*").unionByName(docs.filter("doc_id IS NULL").select(*cols))


def _with_fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` and _fp, the fingerprint of each text."""

    def run(part, texts):
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(fingerprints_of(texts).view(np.int64))], [*part.schema.names, "_fp"])

    return map_texts(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", _fp long")
