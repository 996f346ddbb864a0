"""Substring deduplication: compressed FM-indexes per shard, matching statistics by backward search.

A window is ``window`` consecutive words of a document; words covered by a window whose words also start anywhere else are removed.

1. Every window is dealt to the shard of its anchor, the smallest hash among its runs of ``ANCHOR`` words, so that equal windows meet in one shard.
   Consecutive windows with one place of the anchor travel as one segment, each window in exactly one. Segments whose anchor is met once in the corpus hold no repeated window and leave here.
2. Equal segments are one, with the number of places it stands for. Each shard builds an FM-index over its segments (``fm_index``) and
   streams them through it: windows of full matching statistic are found at another place too. Their intervals are the result.
3. Intervals go back to all places of their segment, by document, and cover words there.

An anchor with more than ``HOT`` distinct segments (or 1/100,000 of all, so that such anchors can be broadcast) is cut into single windows, each dealt by its own hash: equal ones are one row by
then, so that no anchor is a hot key. Lookups of segments go through ``lookup.spread_lookup``. Documents are a written table numbered by row, so that equal rows or ids meet nowhere.
Anchors and equal segments are told by 64 and 128 bits of hash; the index compares words themselves.

Defined cases: words are kept apart by ``[\\x20\\x09-\\x0D]`` and otherwise unchanged; null and texts without words stay without words (empty text); documents shorter than a window
keep all; overlapping places of one document count as places; repeated rows are documents of their own (and lose all that is long enough); ids are only
carried; very long texts are worked on whole; an empty table gives an empty result; other columns pass through, whatever their names, but one named as ``out`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.fm_index import FmIndex
from gleanspark.llm.word_blocks import slices, split_words
from gleanspark.operators.lookup import spread_lookup
from gleanspark.session import discard, materialize, ship

ANCHOR, HOT = 6, 2_000
WORDS_PER_SHARD = 700_000
CUT_BYTES = 2_000_000
SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
PLACES = "rn long, start int, windows int, anchor long, seg long"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word: the sum of random values of its (place, byte) pairs."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64, count=len(words) + 1)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    starts = offsets[:-1] - offsets[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(offsets))
    return mixed(np.add.reduceat(mixed((place.astype(np.uint64) << np.uint64(8) | data) * STEP + STEP), starts))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... base^n, modulo 2^64."""
    factors = np.full(n + 1, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each run of ``width`` values lies, the first of equal ones."""
    have, low = 1, np.arange(len(values), dtype=np.int32)
    while have < width:
        more = min(have, width - have)
        a, b = low[:-more], low[more:]
        low, have = np.where(values[b] < values[a], b, a), have + more
    return low


def segments(words: pa.Array, borders: np.ndarray, window: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Document, first word, windows, anchor and hash of each segment; with ``hot``, of each window with one of these anchors."""
    total = len(words)
    if total < window:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int32, np.int32, np.int64, np.int64))
    coded = words.dictionary_encode()
    h = word_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    k = min(ANCHOR, window)
    grams = np.zeros(total - k + 1, dtype=np.uint64)
    for j, factor in enumerate(powers(BASE, k)[1:]):
        grams += h[j : total - k + 1 + j] * factor
    grams = mixed(grams)
    least = sliding_least(grams, window - k + 1)
    left = np.repeat(borders[1:], np.diff(borders)) - np.arange(total)  # words left in the document
    at = np.flatnonzero(left[: total - window + 1] >= window)
    lowest = least[at]
    anchor = grams[lowest]
    if hot is None:
        first = np.flatnonzero(np.diff(lowest, prepend=-1) != 0)  # as long as the anchor is the same place
    else:
        first = np.flatnonzero(np.isin(anchor, hot))
    count = np.diff(np.append(first, len(at))) if hot is None else np.ones(len(first), dtype=np.int64)
    start = at[first]
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * powers(BASE, total - 1))))
    back = powers(pow(BASE, -1, 1 << 64), total - 1)
    seg = mixed((sums[start + count + window - 1] - sums[start]) * back[start] + count.astype(np.uint64) * STEP)
    anchors = anchor[first] if hot is None else mixed(seg + STEP)
    doc = np.searchsorted(borders, start, side="right") - 1
    return doc, (start - borders[doc]).astype(np.int32), count.astype(np.int32), anchors.view(np.int64), seg.view(np.int64)


def places(docs: DataFrame, window: int, hot: list[int] | None = None) -> DataFrame:
    """All segments of docs(rn, body), or the windows of hot anchors."""
    wanted = None if hot is None else np.array(hot, dtype=np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, CUT_BYTES):
                doc, *found = segments(*split_words(part.column(1), SPACES), window, wanted)
                numbers = part.column(0).to_numpy()[doc]
                yield pa.RecordBatch.from_arrays([pa.array(numbers), *map(pa.array, found)], names=["rn", "start", "windows", "anchor", "seg"])

    return docs.select("rn", "body").mapInArrow(run, PLACES)


def repeated_only(found: DataFrame) -> DataFrame:
    """The places (a written table) whose anchor is found at another place too."""
    many = materialize(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "n", F.lit(True).alias("many")), "anchors")
    return spread_lookup(found, many, "anchor", "n").where("many").drop("many")


def repeated_places(docs: DataFrame, window: int, label: str, hot: list[int] | None = None) -> DataFrame:
    """``repeated_only`` of ``places``, a written table; all places lie on disk only until it is."""
    every = materialize(places(docs, window, hot), label, "zstd")
    found = materialize(repeated_only(every), f"repeated-{label}", "zstd")
    discard(every)
    return found


def distinct_segments(found: DataFrame) -> DataFrame:
    """One row per distinct segment: n places, and one of them."""
    return found.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min("rn").alias("rn"), F.min_by("start", "rn").alias("start"), F.max("windows").alias("windows"))


def segment_texts(docs: DataFrame, distinct: DataFrame, window: int) -> DataFrame:
    """anchor, seg, n and the words (joined by a space) of each distinct segment, cut from the document that the row names."""
    cuts = distinct.groupBy("rn").agg(*[F.collect_list(c).alias(c) for c in ("start", "windows", "anchor", "seg", "n")])  # of one document
    rows = docs.select("rn", "body").join(cuts, "rn").select("body", "start", "windows", "anchor", "seg", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, CUT_BYTES):
                texts = []
                for body, starts, counts in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    words = body.encode().split()
                    texts += [b" ".join(words[s : s + c + window - 1]) for s, c in zip(starts, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i).flatten() for i in (3, 4, 5)), pa.array(texts, pa.binary()).cast(pa.string())], names=["anchor", "seg", "n", "words"])

    return rows.mapInArrow(run, "anchor long, seg long, n long, words string")


def indexed(texts: DataFrame, shards: int, window: int) -> DataFrame:
    """anchor, seg, n and spans (from, to in words) of the segments that hold repeated windows. A partition is a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        words, borders = split_words(table.column("words").combine_chunks(), SPACES)
        coded = words.dictionary_encode()
        flat, lengths = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, np.diff(borders)
        index = FmIndex(flat, lengths, table.column("n").to_numpy(), window)
        whole = index.matching_statistics(flat, lengths) == window
        owner = np.repeat(np.arange(len(lengths)), lengths)
        at = np.flatnonzero(whole)
        fresh = np.ones(len(at), dtype=bool)  # windows that overlap or touch are one span
        fresh[1:] = (np.diff(at) > window) | (owner[at[1:]] != owner[at[:-1]])
        first, last = at[fresh], at[np.append(fresh[1:], True)] if len(at) else at
        doc = owner[first]
        some, per = np.unique(doc, return_counts=True)
        spans = pa.StructArray.from_arrays([pa.array((first - borders[doc]).astype(np.int32)), pa.array((last + window - borders[doc]).astype(np.int32))], names=["from", "to"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32)), spans)
        kept = table.select(["anchor", "seg", "n"]).take(pa.array(some))
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in kept.columns), lists], names=["anchor", "seg", "n", "spans"])

    return texts.repartition(shards, "anchor").mapInArrow(run, "anchor long, seg long, n long, spans array<struct<from:int,to:int>>")


def covered(docs: DataFrame, window: int, hot_segments: int = HOT, words_per_shard: int = WORDS_PER_SHARD) -> DataFrame:
    """rn, froms, tos: the spans of words to remove from docs(rn, body), a written table."""
    found = repeated_places(docs, window, "segments")
    distinct = materialize(distinct_segments(found), "distinct-segments", "zstd")
    bound = max(hot_segments, distinct.count() // 100_000)
    hot = distinct.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > bound)
    wanted = [r.anchor for r in hot.collect()]  # at most 100,000
    if wanted:
        apart = docs.sparkSession.createDataFrame([(a,) for a in wanted], "anchor long")
        whole, single = (found, distinct), repeated_places(docs, window, "windows", wanted)
        found = materialize(found.join(F.broadcast(apart), "anchor", "left_anti").select("rn", "start", "windows", "anchor", "seg").unionAll(single), "repeated-segments", "zstd")
        distinct = materialize(distinct_segments(found), "distinct-segments", "zstd")
        for table in (*whole, single):
            discard(table)
    words = distinct.agg(F.coalesce(F.sum(F.col("windows") + window - 1), F.lit(0))).first()[0]
    texts = segment_texts(docs, distinct, window)
    key = F.array("anchor", "seg").alias("key")
    results = materialize(indexed(texts, max(1, -(-words // words_per_shard)), window).select(key, "n", "spans"), "segment-spans", "zstd")
    discard(distinct)
    hits = spread_lookup(found.select("rn", "start", key), results, "key", "n").where("spans IS NOT NULL")
    spans = hits.select("rn", "start", F.explode("spans").alias("s"))
    return spans.groupBy("rn").agg(F.collect_list(F.col("start") + F.col("s.from")).alias("froms"), F.collect_list(F.col("start") + F.col("s.to")).alias("tos"))  # of one document


def substring_dedup(docs: DataFrame, text_col: str = "text", window: int = 35, out: str = "substring_dedup", hot_segments: int = HOT, words_per_shard: int = WORDS_PER_SHARD) -> DataFrame:
    """docs with the text replaced by the words that stay, joined by one space, and struct ``out``: n_words, n_removed."""
    if window < 2:
        raise ValueError("a window has at least two words")
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    others = F.struct(F.lit(0).alias("c"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept) if c != text_col]).alias("row")
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("rn"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"), others), "numbered", "zstd")
    rows = numbered.join(covered(numbered, window, hot_segments, words_per_shard), "rn", "left").select("row", "body", "froms", "tos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, CUT_BYTES):
                texts, sizes, lost = [], [], []
                for body, froms, tos in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    words = body.encode().split()
                    n, gone = len(words), 0
                    if froms:
                        change = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(change, froms, 1)
                        np.add.at(change, tos, -1)
                        stay = np.flatnonzero(np.cumsum(change)[:n] == 0)
                        gone, words = n - len(stay), [words[i] for i in stay]
                    texts.append(b" ".join(words))
                    sizes.append(n)
                    lost.append(gone)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64())], names=["row", "text", "n_words", "n_removed"])

    made = rows.mapInArrow(run, f"row {numbered.schema['row'].dataType.simpleString()}, text string, n_words long, n_removed long")
    fields = [F.col("text").alias(c) if c == text_col else F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(kept)]
    return made.select(*fields, F.struct("n_words", "n_removed").alias(out))
