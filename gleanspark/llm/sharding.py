"""Shards of near equal size by histogram sort.

Rows are ordered by a 63-bit key: 39 bits of their group's hash, then 24 bits of their number's, so that equal texts lie side by side
and a group larger than a shard, or rows that repeat, can still be cut. Splitters are found by counting, not by sampling: each round proposes probe
keys inside the bracket of every unfinished splitter, counts the exact bytes below all probes in one pass (partial sums per
task, one row per probe gap), and narrows the brackets until each splitter's bytes are within its tolerance. Then the rows,
with their texts, are exchanged once. A shard is ``parts`` consecutive key ranges, so that numbering its rows is the work of many tasks.

The driver holds probes and splitters only (``n_shards * parts`` and ``probes`` numbers).

Defined cases: null sizes count as 0, null groups are one group; repeated rows are cut like others and numbered in any order; of rows with equal keys those with smaller ``order``
columns come first; an empty table gives an empty result; with fewer rows than shards some
shards are empty; columns named shard or slot are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.session import materialize, ship

GROUP_BITS, ROW_BITS = 39, 24


def order_key(group: Column, row: Column) -> Column:
    """Nonnegative long: equal groups are neighbours. row: the row's number, as equal rows must differ."""
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(group), 64 - GROUP_BITS), ROW_BITS)
    return high.bitwiseOR(F.shiftrightunsigned(F.xxhash64(row, F.lit(7)), 64 - ROW_BITS))


def bytes_between(keyed: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows in each of the len(probes)+1 gaps, exactly; a gap holds the keys from its probe on."""
    ship(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1, dtype=np.int64), np.zeros(len(probes) + 1, dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(size, at, batch.column(1).to_numpy(zero_copy_only=False))
            rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(size[some]), pa.array(rows[some])], names=["gap", "size", "rows"])

    parts = keyed.select("key", "size").mapInArrow(run, "gap long, size long, rows long")
    found = parts.groupBy("gap").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = np.zeros(len(probes) + 1, dtype=np.int64), np.zeros(len(probes) + 1, dtype=np.int64)
    for r in found:
        size[r.gap], rows[r.gap] = r.size, r.rows
    return size, rows


def find_splitters(keyed: DataFrame, ranges: int, strict_every: int, tolerance: float, loose: float, probes: int = 4096, most_rounds: int = 64) -> np.ndarray:
    """ranges-1 keys, ascending, that cut keyed(key, size) into ranges of near equal bytes.

    Every strict_every-th splitter is within ``tolerance`` of a shard's bytes, the others within ``loose`` of a range's, or at the
    finest cut that the keys allow.
    """
    count = ranges - 1
    low, high = np.zeros(count, dtype=object), np.full(count, 1 << (GROUP_BITS + ROW_BITS), dtype=object)
    best, miss = np.zeros(count, dtype=object), np.full(count, np.inf)
    targets = limits = None
    open_ = np.arange(count)
    for _ in range(most_rounds):
        if not len(open_):
            break
        brackets: dict[tuple[int, int], int] = {}
        for i in open_:
            brackets[low[i], high[i]] = brackets.get((low[i], high[i]), 0) + 1
        proposed = set()
        for (a, b), n in brackets.items():
            k = max(2, probes * n // len(open_))
            proposed |= {a + (b - a) * j // k for j in range(1, k)} | {b}
        tried = np.array(sorted(p for p in proposed if p < 1 << (GROUP_BITS + ROW_BITS)), dtype=np.int64)
        size, _rows = bytes_between(keyed, tried)
        below = np.cumsum(size)[:-1]
        if targets is None:
            total = int(size.sum())
            targets = np.array([total * j // ranges for j in range(1, ranges)], dtype=np.int64)
            strict = np.arange(1, ranges) % strict_every == 0
            limits = np.where(strict, tolerance * total * strict_every / ranges, loose * total / ranges)
        for i in open_:
            at = int(np.searchsorted(below, targets[i], side="right"))  # the first probe with more below it
            for j in (at - 1, at):
                if 0 <= j < len(tried) and abs(int(below[j]) - int(targets[i])) < miss[i]:
                    best[i], miss[i] = int(tried[j]), abs(int(below[j]) - int(targets[i]))
            if at > 0:
                low[i] = max(low[i], int(tried[at - 1]))
            if at < len(tried):
                high[i] = min(high[i], int(tried[at]))
        open_ = np.array([i for i in open_ if miss[i] > limits[i] and high[i] - low[i] > 1], dtype=int)
    return np.maximum.accumulate(best.astype(np.int64))


def histogram_shards(df: DataFrame, size: Column, group: Column, order: list[Column], n_shards: int = 16, tolerance: float = 0.001, rows_per_range: int = 1_000_000, bytes_per_range: int = 64_000_000, least_parts: int = 16) -> DataFrame:
    """df with shard (int, from 0) and slot (long, gapless from 0 in each shard).

    Rows are written with their keys; splitters are found on keys and sizes alone; then the whole rows go through one exchange.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    key = order_key(group, F.monotonically_increasing_id())  # written down with the row
    written = df.select(F.struct(*kept).alias("row"), key.alias("key"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"), F.struct(*order).alias("rank"))
    written = materialize(written, "shard-rows")
    keyed = written.select("key", "size")
    total = keyed.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    parts = max(least_parts, -(-total.rows // (n_shards * rows_per_range)), -(-total.bytes // (n_shards * bytes_per_range)))
    splitters = find_splitters(keyed, n_shards * parts, parts, tolerance, 0.05)
    _, rows = bytes_between(keyed, splitters)
    before = np.cumsum(rows) - rows
    first = np.concatenate([before[s * parts : (s + 1) * parts] - before[s * parts] for s in range(n_shards)])

    def find(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(splitters, keys.to_numpy(zero_copy_only=False), side="right"), pa.int64())

    # Only keys go to Python.
    placed = written.select("row", "key", "rank").withColumn("range", F.arrow_udf(find, "long")("key"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("key", "rank")) - 1
    numbered = placed.withColumn("place", place)
    return numbered.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        F.floor(F.col("range") / parts).cast("int").alias("shard"),
        (F.element_at(F.expr(f"array({','.join(f'{n}L' for n in first)})"), F.col("range").cast("int") + 1) + F.col("place")).alias("slot"),
    )


def write_shards(df: DataFrame, path: str) -> None:
    """Sharded rows, whole, as Parquet, one folder per shard, each file ordered by slot. Rows stay in the tasks that numbered them."""
    df.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16) -> DataFrame:
    """Per document: id, text, size (UTF-8 bytes plus 1), text_crc32, shard, slot. Equal texts are neighbours.

    size and text_crc32 are those of the text that reached the shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    sharded = histogram_shards(docs.select(id_col, text_col), size, F.xxhash64(text), [F.col(id_col), crc], n_shards)
    return sharded.select(id_col, text_col, size.alias("size"), crc.alias("text_crc32"), "shard", "slot")
