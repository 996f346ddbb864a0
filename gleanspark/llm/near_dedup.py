"""Near-duplicate classes: DartMinHash signatures, banded joining, exact checks.

Documents are sets (or weighted sets) of hashed shingles of five words. Every unit of an element's weight is a cell at which darts
arrive at random, hashed ranks; a dart also hashes to one of the signature's coordinates, and the earliest dart of each
coordinate is kept. A document of total weight W needs the darts up to rank k(ln k + 4)/W only, so throwing costs O(W + k log k), and two
documents agree in a coordinate with the probability of their (weighted) Jaccard similarity. Bands of coordinates are buckets.

Exact copies (equal word sequences) are one node from the start. No bucket is capped, and none is expanded into all its pairs:

1. A node of whose n shingles u occur in no other node that shares a bucket cannot be more similar to any than (n-u)/n. Nodes for
   which that is too little leave; documents that merely share a passage do.
2. Nodes are numbered by u/n, so that the smallest number in a bucket, its hub, is the one most like all others. Each member meets its
   bucket's hub, exact Jaccard on shingles decides, and links are merged into components.
3. Buckets that still hold several components: up to ``small`` members, every pair across components is checked; in larger ones
   the members outside the largest component are compared with all others in blocks of at most ``BLOCK`` by ``BLOCK`` documents, as one
   matrix product each, which gives links between components, not pairs.

With 32 bands of 5 a pair of similarity 0.8 misses all buckets with probability 3e-6.

Defined cases: null, empty and wordless texts are no near copies of anything, each is its own class; fewer than five words are one
shingle; equal texts share a class; class_id is the smallest id of the class (null if it has none); repeated rows share their class;
an empty table gives an empty result; very long texts are used whole; other columns are ignored.

The list of nodes that share buckets (24 bytes each) is broadcast if it counts at most ``broadcast_nodes``, else joined by shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.operators.lookup import components, spread_lookup
from gleanspark.session import materialize, ship

BANDS, ROWS, SHINGLE, SIMILAR = 32, 5, 5, 0.8
BLOCK = 256
PAIRS = 128
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _wait(z: np.ndarray) -> np.ndarray:
    return -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def _throw(out: np.ndarray, owner: np.ndarray, rank: np.ndarray, dart: np.ndarray, keep: np.ndarray | None) -> None:
    """Keep the earliest dart of each coordinate; out holds rank and dart in one number."""
    if keep is not None:
        owner, rank, dart = owner[keep], rank[keep], dart[keep]
    k = out.shape[1]
    place = owner * k + (mix(dart ^ GOLDEN) % np.uint64(k)).astype(np.int64)
    packed = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | dart >> np.uint64(32)
    np.minimum.at(out.reshape(-1), place, packed)


def signatures(elements: np.ndarray, offsets: np.ndarray, k: int, seed: int = 0, weights: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash signatures (documents x k, uint64) of the element runs that offsets delimit; weights default to 1."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        cell = mix(elements.astype(np.uint64) + np.uint64(seed + 1) * GOLDEN)
    limit = None
    total = n.astype(np.float64)
    if weights is not None:
        times = np.ceil(weights).astype(np.int64)
        level = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        limit = np.repeat(weights, times) - level
        total = np.bincount(owner, weights, minlength=len(n))
        owner = np.repeat(owner, times)
        with np.errstate(over="ignore"):
            cell = np.where(level > 0, mix(np.repeat(cell, times) ^ mix(level.astype(np.uint64) * GOLDEN)), np.repeat(cell, times))
    out = np.full((len(n), k), np.iinfo(np.uint64).max, dtype=np.uint64)
    todo = np.flatnonzero(total > 0)
    reach = np.zeros(len(n))
    reach[todo] = k * (math.log(k) + 4) / total[todo]
    while len(todo):
        picked = np.zeros(len(n), dtype=bool)
        picked[todo] = True
        mine = picked[owner]
        _arrivals(out, cell[mine], owner[mine], reach, None if limit is None else limit[mine])
        todo = todo[(out[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        reach[todo] *= 3
    return out


def _arrivals(out: np.ndarray, cell: np.ndarray, owner: np.ndarray, reach: np.ndarray, limit: np.ndarray | None) -> None:
    """Throw the darts of each cell up to its document's reach."""

    def under(dart: np.ndarray, cap: np.ndarray) -> np.ndarray:
        return (mix(dart + np.uint64(1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < cap

    far = reach[owner] > 40  # few cells with many darts each: all their waits at once
    for r in np.unique(reach[owner[far]]):
        own = np.flatnonzero(far & (reach[owner] == r))
        m = int(r + 8 * math.sqrt(r) + 20)
        for part in np.array_split(own, max(1, len(own) * m // 4_000_000)):
            with np.errstate(over="ignore"):
                dart = mix(cell[part][:, None] + np.arange(m, dtype=np.uint64)[None, :] * GOLDEN)
            rank = np.cumsum(_wait(dart), axis=1)
            keep = rank <= r
            if limit is not None:
                keep &= under(dart, limit[part][:, None])
            row, _ = np.nonzero(keep)
            _throw(out, owner[part][row], rank[keep], dart[keep], None)
    cell, owner, i = cell[~far], owner[~far], 0
    limit = None if limit is None else limit[~far]
    rank = np.zeros(len(cell))
    while len(cell):
        with np.errstate(over="ignore"):
            dart = mix(cell + np.uint64(i) * GOLDEN)
        rank = rank + _wait(dart)
        near = rank <= reach[owner]
        cell, owner, rank, dart, i = cell[near], owner[near], rank[near], dart[near], i + 1
        limit = None if limit is None else limit[near]
        _throw(out, owner, rank, dart, None if limit is None else under(dart, limit))


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One bucket number (int64) per document and band."""
    n, k = signature.shape
    out = np.tile(np.arange(k // rows, dtype=np.uint64) * GOLDEN, (n, 1))
    for i in range(rows):
        out = mix(out ^ signature[:, i::rows][:, : k // rows])
    return out.view(np.int64)


def words_of(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def shingles_of(words: Column, size: int = SHINGLE) -> Column:
    """Distinct hashed shingles; all the words together if they are fewer."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, size))))

    return F.get(F.transform(F.array(words), of), F.lit(0))  # binds the words once


def node_of(words: Column) -> Column:
    """128 bits of the word sequence."""
    return F.unhex(F.md5(F.array_join(words, " ")))


def banded(rows: DataFrame, keep: list[str], seed: int, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """rows(keep..., shingles) to (keep..., buckets array<long>)."""
    ship(rows.sparkSession)
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            step = max(1, len(batch) * CHUNK // max(len(lists.flatten()), 1))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                own = part.column(len(keep))
                offsets = own.offsets.to_numpy() - own.offsets[0].as_py()
                made = bands(signatures(own.flatten().to_numpy(zero_copy_only=False).view(np.uint64), offsets, n_bands * n_rows, seed), n_rows)
                ends = np.arange(len(part) + 1, dtype=np.int32) * made.shape[1]
                buckets = pa.ListArray.from_arrays(pa.array(ends), pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], buckets], names=[*keep, "buckets"])

    return rows.select(*keep, "shingles").mapInArrow(run, f"{types}, buckets array<long>")


class _Search:
    """Rounds of checks over bucket memberships (bucket, node); keeps the components found so far."""

    def __init__(self, shingles: DataFrame, threshold: float, small: int) -> None:
        self.shingles, self.threshold, self.small = shingles, threshold, small
        self.labels: DataFrame | None = None

    def comps(self, members: DataFrame) -> DataFrame:
        """members with comp, each node's component so far."""
        if self.labels is None:
            return members.withColumn("comp", F.col("node"))
        return members.join(self.labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def decided(self, pairs: DataFrame) -> DataFrame:
        """Of pairs(a, b, ca, cb) the components (a, b) whose members are similar, by exact Jaccard."""
        pairs = materialize(pairs.where("a <> b").select("a", "b", "ca", "cb").distinct(), "near-pairs")
        # A hub's row is copied for every PAIRS of its pairs, so that no task gathers them all; b is met in few pairs (its buckets' hubs or small buckets).
        parts = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PAIRS).cast("int"))
        parts = materialize(parts, "near-hub-parts")
        dealt = spread_lookup(pairs, parts, "a", "n").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        hubs = self.shingles.join(parts.select(F.col("a").alias("node"), "parts"), "node")
        hubs = hubs.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        with_b = dealt.join(self.shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        with_both = with_b.join(hubs, ["a", "part"])
        both = F.size(F.array_intersect("sa", "sb"))
        linked = with_both.where(both / (F.size("sa") + F.size("sb") - both) >= self.threshold)
        return linked.select(F.col("ca").alias("a"), F.col("cb").alias("b"))

    def merge(self, links: DataFrame) -> None:
        """Join the components that links(a, b) name."""
        merged = components(links, "near-links")
        if self.labels is None:
            self.labels = merged
            return
        moved = self.labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("now")), "comp", "left")
        moved = moved.select("node", F.coalesce("now", "comp").alias("comp"))
        fresh = merged.join(self.labels, "node", "left_anti")
        self.labels = materialize(moved.unionByName(fresh), "near-labels")

    def open_buckets(self, members: DataFrame) -> DataFrame:
        """The memberships, with comp and the bucket's size, of buckets that hold several components."""
        known = self.comps(members)
        spread = known.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
        mixed = materialize(spread.where("lo <> hi").select("bucket", "n", F.col("n").alias("rows")), "near-mixed")
        return materialize(spread_lookup(known, mixed, "bucket", "rows").where("n IS NOT NULL"), "near-open")

    def hub_pairs(self, members: DataFrame) -> DataFrame:
        """Each member with its bucket's hub, the smallest node, where their components differ."""
        hubs = members.groupBy("bucket").agg(F.min("node").alias("a"), F.min_by("comp", "node").alias("ca"), F.count("*").alias("rows"))
        joined = spread_lookup(members, materialize(hubs, "near-hubs"), "bucket", "rows").where(F.col("ca") != F.col("comp"))
        return joined.select("a", F.col("node").alias("b"), "ca", F.col("comp").alias("cb"))

    def cross_pairs(self, members: DataFrame) -> DataFrame:
        """Every pair across components within a bucket."""
        other = members.select("bucket", F.col("node").alias("b"), F.col("comp").alias("cb"))
        pairs = members.select("bucket", F.col("node").alias("a"), F.col("comp").alias("ca")).join(other, "bucket")
        return pairs.where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b", "ca", "cb")

    def block_links(self, members: DataFrame) -> DataFrame:
        """Components (a, b) with similar members in members(bucket, node, comp): those outside a bucket's largest component against all."""
        sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        shape = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        shape = shape.select("bucket", "main", blocks(F.col("all") - F.col("most")).alias("left"), blocks(F.col("all")).alias("right"), F.col("all").alias("rows"))
        rows = spread_lookup(members, materialize(shape, "near-shapes"), "bucket", "rows")
        own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        outside = rows.where("comp <> main").select("bucket", "node", "comp", own("left", 0).alias("i"), every("right").alias("j"), F.lit(True).alias("outer"))
        inside = rows.select("bucket", "node", "comp", every("left").alias("i"), own("right", 1).alias("j"), F.lit(False).alias("outer"))
        placed = outside.unionByName(inside).join(self.shingles, "node")
        threshold = self.threshold

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(similar_components(pdf[pdf.outer], pdf[~pdf.outer], threshold), columns=["a", "b"])

        return placed.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long")

    def settle(self, members: DataFrame) -> None:
        """members(bucket, node), of buckets with two nodes or more."""
        self.merge(self.decided(self.hub_pairs(self.comps(members))))
        left = self.open_buckets(members)
        if not left.isEmpty():
            few, many = left.where(F.col("n") <= self.small), left.where(F.col("n") > self.small)
            self.merge(self.decided(self.cross_pairs(few)).unionByName(self.block_links(many)))


def similar_components(left: pd.DataFrame, right: pd.DataFrame, threshold: float, columns: int = 16_384) -> list[tuple[int, int]]:
    """Distinct pairs of components that hold a similar pair of rows (comp, shingles), one from each side."""
    n, m = len(left), len(right)
    if not n or not m:
        return []
    lists = [*left.shingles, *right.shingles]
    sizes = np.array([len(x) for x in lists])
    _, place, met = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = met[place] > 1  # a shingle met once is in no intersection
    column = (np.cumsum(met > 1) - 1)[place[shared]]
    row = np.repeat(np.arange(n + m), sizes)[shared]
    both = np.zeros((n, m), dtype=np.float32)
    for first in range(0, int((met > 1).sum()), columns):
        part = (column >= first) & (column < first + columns)
        held = np.zeros((n + m, columns), dtype=np.float32)
        held[row[part], column[part] - first] = 1
        both += held[:n] @ held[n:].T
    close = both / (sizes[:n, None] + sizes[None, n:] - both) >= threshold
    ca, cb = left.comp.to_numpy(), right.comp.to_numpy()
    i, j = np.nonzero(close & (ca[:, None] != cb[None, :]))
    return sorted({(min(a, b), max(a, b)) for a, b in zip(ca[i].tolist(), cb[j].tolist(), strict=True)})


def crowded(members: DataFrame, label: str) -> DataFrame:
    """The distinct memberships of buckets that hold two nodes or more."""
    members = members.distinct()
    held = members.groupBy("bucket").count().where("count > 1").withColumn("n", F.col("count"))
    return materialize(spread_lookup(members, materialize(held, "near-held"), "bucket", "count").where("n IS NOT NULL").drop("n"), label)


def _gathered(worded: DataFrame, needed: DataFrame, hashes: DataFrame, broadcast_nodes: int) -> DataFrame:
    """number, shingles of the needed nodes: their texts are gathered, once each, and only then cut into shingles. hashes: (hash) of all rows."""
    texts = worded.where(F.size("words") > 0).select(node_of(F.col("words")).alias("hash"), F.array_join("words", " ").alias("text"))
    if needed.count() <= broadcast_nodes:
        texts = texts.join(F.broadcast(needed), "hash")
    else:
        counted = hashes.groupBy("hash").agg(F.count("*").alias("rows")).join(needed, "hash", "left")
        texts = spread_lookup(texts, materialize(counted, "near-counted"), "hash", "rows").where("number IS NOT NULL")
    texts = texts.groupBy("number").agg(F.first("text").alias("text"))  # tasks send one of their copies at most
    return materialize(texts.select("number", shingles_of(F.split("text", " ")).alias("shingles")), "near-shingles")


def _ranked(shingles: DataFrame, threshold: float) -> DataFrame:
    """number, node of those that may be similar enough to another: node orders them by the share of shingles that no other has."""
    each = shingles.select("number", F.explode("shingles").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("number").alias("number")).where("n = 1")
    alone = alone.groupBy("number").agg(F.count("*").alias("alone"))
    share = F.coalesce(F.col("alone"), F.lit(0)) / F.size("shingles")
    kept = shingles.join(alone, "number", "left").where(1 - share >= threshold)
    return materialize(kept.select("number", F.shiftleft(F.floor(share * 255), 53).bitwiseOR(F.col("number")).alias("node"), "shingles"), "near-ranked")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILAR, small: int = 32, broadcast_nodes: int = 1_000_000) -> DataFrame:
    """One row per row of docs: id, node (128 bits of the words; null without words), class_id, class_size, first (the row that stands for its class)."""
    worded = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    rows = worded.select("id", F.when(F.size("words") > 0, node_of(F.col("words"))).alias("hash"), F.when(F.size("words") > 0, shingles_of(F.col("words"))).alias("shingles"))
    with_buckets = materialize(banded(rows, ["id", "hash"], 0), "near-bands")
    met = crowded(with_buckets.where("hash IS NOT NULL").select("hash", F.explode("buckets").alias("bucket")), "near-buckets")
    # Numbers are written down with the hashes, and hold from then on; 53 bits leave room for the rank.
    needed = materialize(met.select("hash").distinct().withColumn("number", F.monotonically_increasing_id()), "near-nodes")
    ranked = _ranked(_gathered(worded, needed, with_buckets.where("hash IS NOT NULL").select("hash"), broadcast_nodes), threshold)
    names = materialize(needed.join(ranked.select("number", "node"), "number").select("hash", "node"), "near-names")
    search = _Search(ranked.select("node", "shingles"), threshold, small)
    search.settle(crowded(met.join(names, "hash").select("bucket", "node"), "near-members"))
    # What rows are told is told per node (equal texts), then per class; no class's or node's rows need to meet.
    first = F.min(F.struct(F.col("id").isNull(), F.col("id")))
    nodes = with_buckets.where("hash IS NOT NULL").groupBy("hash").agg(first.alias("least"), F.count("*").alias("rows"))
    classes = search.comps(names).select("hash", "comp")
    key = F.coalesce(F.col("comp").cast("string"), F.hex("hash"))
    nodes = materialize(nodes.join(classes, "hash", "left").select("hash", "least", "rows", key.alias("class")), "near-rows")
    least = F.min(F.struct(F.col("least").alias("id"), F.col("hash").alias("node")))
    sizes = materialize(nodes.groupBy("class").agg(least.alias("first"), F.sum("rows").alias("class_size"), F.count("*").alias("nodes")), "near-sizes")
    told = materialize(spread_lookup(nodes.select("hash", "rows", "class"), sizes, "class", "nodes").select("hash", "rows", "first", "class_size"), "near-told")
    found = spread_lookup(with_buckets.select("id", "hash"), told, "hash", "rows")
    best = F.col("first.id")
    return found.select(
        F.col("id").alias(id_col),
        F.col("hash").alias("node"),
        F.when(F.col("hash").isNull(), F.col("id")).otherwise(best["id"]).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce(F.col("id").eqNullSafe(best["id"]) & (F.col("hash") == F.col("first.node")), F.lit(True)).alias("first"),
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """docs with one row per class left: that with the smallest id, and of several such rows one. Wordless rows all stay."""

    def key(ident: Column, node: Column) -> Column:
        return F.unhex(F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("null")).cast("binary"), F.coalesce(node, F.lit("wordless").cast("binary")))))

    classes = near_classes(docs, id_col, text_col, threshold).where("node IS NOT NULL").select(key(F.col(id_col), F.col("node")).alias("k"), "first")
    told = materialize(classes.groupBy("k").agg(F.count("*").alias("n"), F.max("first").alias("stays")), "near-stays")
    rows = docs.select(F.struct("*").alias("row"), words_of(F.col(text_col)).alias("words"))
    rows = rows.select("row", F.when(F.size("words") > 0, node_of(F.col("words"))).alias("node"))
    keyed = rows.select("row", F.when(F.col("node").isNotNull(), key(F.col("row").getField(id_col), F.col("node"))).alias("k"))
    staying = spread_lookup(keyed, told, "k", "n").where("stays OR k IS NULL")
    # Of repeated rows one stays: tasks send one of theirs at most. Wordless rows are groups of their own.
    own = F.unhex(F.md5(F.concat(F.lit("wordless"), F.monotonically_increasing_id().cast("string"))))
    once = staying.select("row", F.coalesce("k", own).alias("k")).groupBy("k").agg(F.first("row").alias("row"))
    return once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
