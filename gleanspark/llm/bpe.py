"""Byte-level BPE over a distinct-word table.

Method. Spark splits texts into words with the pre-tokenizer's pattern, counts them, and each distinct
word is encoded once:

* the most frequent words, at most ``table_words``, form the distinct-word table: those whose count reaches a threshold, which
  a histogram of the counts gives. Its size is bounded by that number and by ``table_chars`` per word, so that it is
  broadcast; in running text it holds nearly all occurrences;
* every other word is rare by construction. Rare words of a block of documents are made distinct again and
  encoded once per block, since sending each of their few occurrences to a shuffled table and back by
  position would move more than the texts themselves (README has the figures).

Ids go back by position: each word of a text looks its ids up at its own place, and the id runs are
concatenated in that order. Decoding joins each id with the id-to-piece table: as that is as large as the
vocabulary, thus bounded, and its keys are 0 to n - 1, the join is a gather in each task instead of a row per id. It concatenates the pieces' bytes in order and reads them as UTF-8, with U+FFFD for
what is not valid, as the tokenizers library does.

Java's and the library's Unicode tables differ only in code points that Java calls unassigned; texts with
any of those are split by the library's own pre-tokenizer.

Defined cases: null and empty texts have no ids and decode to the empty text; special tokens in a text are single
ids; repeated rows and ids are encoded row by row; an empty table gives an empty result; very long texts and
words are encoded whole; other columns pass through ``encode`` and ``decode``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.packing import byte_alphabet
from gleanspark.session import materialize, ship

#: Fixed value: the pre-tokenizer's pattern, with its white space written out for Java.
SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
BLOCK_BYTES = 3_000_000


class ByteBpe:
    """A byte-level BPE file of the tokenizers library: ids of words, pieces of ids."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_alphabet()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        merged = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        #: Words between NULs; each NUL is an id of its own.
        self.batch = tiktoken.Encoding("batch", pat_str=r"[^\x00]+|\x00", mergeable_ranks=merged, special_tokens={})
        self.nul = merged[b"\0"]

    @cached_property
    def whole(self):  # noqa: ANN201
        """The library's own tokenizer; few blocks need it, and it takes memory."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.no_truncation()
        whole.no_padding()
        return whole

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words and how many each has; a word is one match of the pre-tokenizer, or a special token."""
        odd = {i: self.whole.encode(w, add_special_tokens=False).ids for i, w in enumerate(words) if "\0" in w or w in self.specials}
        flat = np.array(self.batch.encode_ordinary("".join(("x" if i in odd else w) + "\0" for i, w in enumerate(words))), dtype=np.int32)
        ends = np.flatnonzero(flat == self.nul)
        lengths = np.diff(ends, prepend=-1) - 1
        flat = flat[flat != self.nul]
        if odd:
            parts = np.split(flat, np.cumsum(lengths)[:-1])
            for i, ids in odd.items():
                parts[i] = np.array(ids, dtype=np.int32)
            flat, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
        return flat, lengths.astype(np.int64)

    def split(self, text: str) -> list[str]:
        """The words of a text as the library itself splits it."""
        parts, rest = [], text
        while rest:
            at, special = min(((i, s) for s in self.specials if (i := rest.find(s)) >= 0), default=(len(rest), ""))
            parts += [rest[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(rest[:at])] + [special] * bool(special)
            rest = rest[at + len(special) :]
        return parts


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """The bytes of each id."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_alphabet()
    known = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    known |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return pa.array([known.get(i, b"") for i in range(max(known) + 1)], pa.large_binary())


def split_words(text: Column, specials: list[str]) -> Column:
    """The text's words in order. Special tokens are cut out first, as the library does."""
    plain = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    if not specials:
        return plain
    either = "|".join("\\Q" + s + "\\E" for s in specials)
    found = text.rlike(either)
    gaps = F.transform(F.split(text, either, -1), lambda g: F.regexp_extract_all(g, F.lit(WORDS), F.lit(0)))
    marks = F.transform(F.regexp_extract_all(text, F.lit(either), F.lit(0)), lambda s: F.array(s))
    mixed = F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), marks.alias("mark")), lambda x: F.concat(x["gap"], F.coalesce(x["mark"], F.array().cast("array<string>")))))
    return F.when(found, mixed).otherwise(plain)


def unsure(text: Column) -> Column:
    """True where Java may split otherwise than the library: some code point is unassigned in Java's tables."""
    return (F.octet_length(text) > F.char_length(text)) & text.rlike(r"\p{Cn}")


def word_table(docs: DataFrame, tokenizer: str, text_col: str = "text", table_words: int = 300_000, table_chars: int = 64) -> DataFrame:
    """(word, ids): the most frequent distinct words, each encoded once. Words of one size class of counts are all in it, or none."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    specials = byte_bpe(tokenizer).specials
    words = docs.where(~unsure(text)).select(F.explode(split_words(text, specials)).alias("word"))
    counts = words.groupBy("word").count().where((F.char_length("word") <= table_chars) & (F.col("count") > 1))
    counts = materialize(counts.select("word", F.floor(F.log2("count") * 64).cast("int").alias("size_class")), "word-counts")
    room, least = table_words, 1 << 30
    for row in counts.groupBy("size_class").count().orderBy(F.desc("size_class")).collect():  # at most 64 classes per power of two
        if (room := room - row[1]) < 0:
            break
        least = row.size_class
    frequent = counts.where(F.col("size_class") >= least).select("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            flat, lengths = bpe.words(batch.column(0).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["word", "ids"])

    return materialize(frequent.mapInArrow(run, "word string, ids array<int>"), "word-table")


def _ragged(values: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[first:first+length] one behind the other, and where each ends."""
    until = np.cumsum(lengths)
    return values[np.repeat(first - (until - lengths), lengths) + np.arange(until[-1] if len(until) else 0)], until


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, packed: bool = False, table_words: int = 300_000, table_chars: int = 64) -> DataFrame:
    """The columns ``keep`` (all) of docs, with ids_col: ids as the tokenizers library gives them for whole texts.

    ids_col is array<int>, or with ``packed`` binary: little-endian unsigned 32-bit integers, as token files hold them.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    specials = byte_bpe(tokenizer).specials
    table = word_table(docs, tokenizer, text_col, table_words, table_chars).toArrow()  # at most table_words rows
    known = spark.sparkContext.broadcast(_packed(table))
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != ids_col.lower()]
    rows = docs.select(
        F.struct(*kept).alias("row"),
        F.when(~unsure(text), split_words(text, specials)).alias("words"),
        F.when(unsure(text), text).alias("whole"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        table = _Table(*known.value)
        for batch in batches:
            for part in _blocks(batch):
                words = part.column(1)
                if part.column(2).null_count < len(part):
                    split = [w if t is None else bpe.split(t) for w, t in zip(words.to_pylist(), part.column(2).to_pylist(), strict=True)]
                    words = pa.array(split, pa.list_(pa.string()))
                flat = words.flatten()
                # One dictionary per block: each distinct word is looked up, or encoded, once.
                coded = flat.dictionary_encode()
                values, first, lengths = table.ids(coded.dictionary, bpe)
                place = coded.indices.to_numpy(zero_copy_only=False)
                ids, until = _ragged(values, first[place], lengths[place])
                borders = words.offsets.to_numpy() - words.offsets[0].as_py()
                offsets = np.concatenate(([0], until))[borders].astype(np.int32)
                if packed:
                    made = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets * 4), pa.py_buffer(ids.astype("<u4"))])
                else:
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=["row", "ids"])

    encoded = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, ids {'binary' if packed else 'array<int>'}")
    return encoded.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("ids").alias(ids_col))


def _packed(table: pa.Table) -> tuple[bytes, bytes, bytes]:
    """The table as words, flat ids and lengths, ready to be sent."""
    words = table.column(0).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("word", words.type)])) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([words], names=["word"]))
    ids = table.column(1).combine_chunks()
    return sink.getvalue().to_pybytes(), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes(), pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()


class _Table:
    """The broadcast word table, with what its words' ids are."""

    def __init__(self, words: bytes, ids: bytes, lengths: bytes) -> None:
        self.words = pa.ipc.open_stream(words).read_all().column(0).combine_chunks()
        self.flat = np.frombuffer(ids, dtype=np.int32)
        self.lengths = np.frombuffer(lengths, dtype=np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths

    def ids(self, words: pa.Array, bpe: ByteBpe) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, first place and length for each of the distinct words given."""
        at = pc.index_in(words.cast(self.words.type), value_set=self.words)
        rare = at.is_null().to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False)
        first = np.zeros(len(words), dtype=np.int64)
        lengths = np.zeros(len(words), dtype=np.int64)
        if len(self.words):
            first[~rare], lengths[~rare] = self.first[at[~rare]], self.lengths[at[~rare]]
        own, sizes = bpe.words(words.filter(pa.array(rare)).to_pylist())
        first[rare], lengths[rare] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        return np.concatenate([self.flat, own]), first, lengths


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about BLOCK_BYTES, so that a block's memory doesn't follow the rows of a batch."""
    rows = max(1, len(batch) * BLOCK_BYTES // max(batch.nbytes, 1))
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def decode(docs: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with ``out``: the text of ids_col (array<int>, or packed binary; null: empty), special tokens included."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    rows = docs.select(F.struct(*kept).alias("row"))
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(tokenizer)
        for batch in batches:
            for part in _blocks(batch):
                column = part.column(0).flatten()[at]
                if pa.types.is_binary(column.type):
                    lists = [np.frombuffer(v.as_py() or b"", dtype="<u4") for v in column]
                else:
                    lists = [np.array(v.as_py() or [], dtype=np.int64) for v in column]
                borders = np.cumsum([0] + [len(x) for x in lists])
                joined = known.take(pa.array(np.concatenate(lists).astype(np.int64)))  # the join by id; its bytes lie in the order of the ids
                ends = np.frombuffer(joined.buffers()[1], dtype=np.int64, count=len(joined) + 1) if len(joined) else np.zeros(1, np.int64)
                data = memoryview(joined.buffers()[2]) if len(joined) else b""
                texts = [str(data[a:b], "utf-8", "replace") for a, b in zip(ends[borders[:-1]], ends[borders[1:]], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    decoded = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return decoded.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("text").alias(out))
