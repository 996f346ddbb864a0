"""Words of texts in blocks: a table of each block's distinct words, and documents as places in it.

A block is some megabytes of documents of one task. Its distinct words are few beside its words, so that tables over words meet (block, word) pairs,
not every word; each block's answers then meet its documents again by the block's number. Everything in one task is bounded by the block's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.session import materialize, ship

BLOCK_BYTES = 16_000_000


def split_words(texts: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    """The flat words of texts (nulls: none), and the borders of each text's words. table maps bytes; what it maps to a space separates."""
    data, begins = _joined(texts)
    mapped = np.frombuffer(data.translate(table), dtype=np.uint8)
    inside = mapped != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(mapped[inside])])
    return words, np.searchsorted(starts, begins)


def _joined(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts as bytes with a space between each two, and where each begins; the last entry is the end."""
    parts = [(t or "").encode() for t in texts.to_pylist()]
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])
    return b" ".join(parts) + b" ", starts


def slices(batch: pa.RecordBatch, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes, at least one row each."""
    rows = max(1, len(batch) * most // max(batch.nbytes, 1))
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def word_blocks(docs: DataFrame, table: bytes, label: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(row, text) as a written table of two kinds of rows.

    Documents: block, row, n_words, places (the numbers of their words, in order, as ``packed_places``). Words: block, word, local (its number in the block), n (its
    count there).
    """
    kind = docs.schema["row"].dataType
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        names = ["block", "row", "n_words", "places", "word", "local", "n"]
        for batch in batches:
            for part in slices(batch, block_bytes):
                words, borders = split_words(part.column(1), table)
                coded = words.dictionary_encode()
                met = coded.indices.to_numpy(zero_copy_only=False)
                m, d = len(part), len(coded.dictionary)
                counts = np.bincount(met, minlength=d).astype(np.int64)
                order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
                local = np.empty(d, dtype="<i4")
                local[order] = np.arange(d)
                packed = packed_places(local[met], borders)
                own = pa.array(np.full(m, block))
                yield pa.RecordBatch.from_arrays([own, part.column(0), pa.array(np.diff(borders)), packed, pa.nulls(m, pa.string()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names=names)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, block)), pa.nulls(d, part.column(0).type), pa.nulls(d, pa.int64()), pa.nulls(d, pa.binary()), coded.dictionary.cast(pa.string()), pa.array(local), pa.array(counts)], names=names)
                block += 1

    schema = f"block long, row {kind.simpleString()}, n_words long, places binary, word string, local int, n long"
    return materialize(docs.select("row", "text").mapInArrow(run, schema), label)


def documents_of(blocks: DataFrame) -> DataFrame:
    return blocks.where("places IS NOT NULL").select("block", "row", "n_words", "places")


def words_of(blocks: DataFrame) -> DataFrame:
    return blocks.where("local IS NOT NULL").select("block", "word", "local", "n")


def packed_places(numbers: np.ndarray, borders: np.ndarray) -> pa.Array:
    """32-bit numbers of each row as four planes of bytes, lowest first: the upper planes are nearly all zeros, which compress away."""
    planes = numbers.astype("<i4").view(np.uint8).reshape(-1, 4)
    return pa.array([planes[a:b].T.tobytes() for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)], pa.binary())


def flat_places(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of packed places, one behind the other, and the borders of each row's."""
    parts = [np.frombuffer(p, dtype=np.uint8).reshape(4, -1).T for p in column.to_pylist()]
    borders = np.cumsum([0] + [len(p) for p in parts])
    return (np.concatenate(parts) if parts else np.zeros((0, 4), dtype=np.uint8)).reshape(-1, 4).copy().view("<i4").reshape(-1), borders


def meet(documents: DataFrame, values: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(a block's documents, its values), for every block that has documents."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right.sort_by("local"))

    apart = values.select(*[F.col(c).alias(c) for c in values.columns])  # both sides may come from one table
    return documents.groupBy("block").cogroup(apart.groupBy("block")).applyInArrow(each, schema)
