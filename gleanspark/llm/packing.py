"""Packing token pieces into fixed-length sequences by shortest-pack-first histogram packing.

Method: a document's ids are cut at every ``capacity``; only the histogram of piece lengths (at most
``capacity`` rows, whatever the corpus holds) goes to the driver, where lengths are placed longest first,
each into the packs with the most room, as counts of packing patterns. The patterns go back as ranges of
ranks per length, and each piece, ranked among the pieces of its length, finds its sequence and offset by
one join with that table. Ranks are counted per (length, salt) and shifted by the salts before, so a length
that a third of all pieces share is not one task's work. Lengths are counted first, without gathering ids; then the texts
are tokenised and the ids travel with their pieces through the ranks to their sequence, at 16 bits each where
the vocabulary allows it, so that they are never stored in between. :func:`sequences` places them and pads.

Tokens: :class:`WordBpe` gives the ids of a word-level BPE file of the tokenizers library. Per chunk of
texts it finds word borders with numpy, encodes each distinct word once and gathers. Texts with
characters from U+0180 on, U+0130, NUL or special tokens go through the library itself.

Defined cases: a null or empty text is the single end id; repeated rows and ids are packed row by row;
ties in length are ranked by id, start and checksum; an empty table gives an empty result; very long texts
are many pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.session import materialize, ship

CHUNK_CHARS = 3_000_000
FAST_LIMIT = 0x180
SPACE, LETTER, NUMBER, OTHER = range(4)
#: The contractions that the pre-tokenizer splits off, and what it holds to be white space below U+0180.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACES = (*range(9, 14), 32, 0x85, 0xA0)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    """Ids of a lower-casing word BPE with ``</w>`` ends, equal to the tokenizers library's, many words at a time."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_alphabet()
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

        def raw(token: str) -> bytes:
            stem = token.removesuffix("</w>")
            return bytes(letters[c] for c in stem) + b"\0" * (stem != token)

        # A word's end is a NUL byte whose merge with any last byte comes before all other merges.
        order = [c for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        tokens = order + [f"{c}</w>" for c in order] + [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)]
        self.words = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks={raw(t): i for i, t in enumerate(tokens)}, special_tokens={})
        self.ids = np.array([vocab[t] for t in tokens], dtype=np.uint32)
        self.last = np.array([t.endswith("</w>") for t in tokens])
        chars = [chr(i) for i in range(FAST_LIMIT)]
        self.lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else 0 for c in chars], dtype=np.uint16)
        kinds = [SPACE if i in SPACES else LETTER if c.isalpha() else NUMBER if c.isnumeric() else OTHER for i, c in enumerate(chars)]
        self.kind = np.array(kinds, dtype=np.uint8)

    @cached_property
    def whole(self):  # noqa: ANN201
        """The library's own tokenizer; few texts need it, and it takes memory."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.no_truncation()
        whole.no_padding()
        return whole

    def _starts(self, chars: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """True where a word begins. The last character is a space."""
        before = np.concatenate(([SPACE], kind[:-1]))
        starts = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
        marks = np.flatnonzero((chars == ord("'")) & (before != OTHER))
        for tail in CONTRACTIONS:
            found = marks[marks + len(tail) < len(chars)]
            for i, c in enumerate(tail):
                found = found[chars[found + 1 + i] == ord(c)]
            for i in range(len(tail)):
                starts[found + 1 + i] = False
            after = found + 1 + len(tail)
            after = after[after < len(chars)]
            starts[after] = kind[after] != SPACE
        return starts

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ranks of the distinct words' tokens; for each word where its own begin and how many they are; for each text the place behind its last id."""
        chars = self.lower[np.frombuffer((" ".join(texts) + " ").encode("utf-16-le"), dtype=np.uint16)]
        kind = self.kind[chars]
        starts = self._starts(chars, kind)
        inside = kind != SPACE
        ends = inside.copy()
        ends[:-1] &= starts[1:] | ~inside[1:]
        # One NUL behind each word: the space that follows it, or one put in where the next word follows at once.
        held = inside.copy()
        held[1:] |= inside[:-1]
        marked = np.where(inside, chars, 0)[held]
        marked = np.insert(marked, np.flatnonzero((ends[:-1] & inside[1:])[held[:-1]]) + 1, 0)
        data = marked.tobytes().decode("utf-16-le").encode()
        borders = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 0) + 1
        offsets = np.concatenate(([0], borders)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(borders), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        place = words.indices.to_numpy(zero_copy_only=False)
        ranks = np.array(self.words.encode_ordinary("".join(words.dictionary.to_pylist())), dtype=np.int32)
        behind = (np.flatnonzero(self.last[ranks]) + 1 if len(ranks) else ranks).astype(np.int32)
        first = np.concatenate((np.zeros(1, dtype=np.int32), behind[:-1])) if len(behind) else behind
        lengths = (behind - first)[place] if len(place) else np.zeros(0, dtype=np.int32)
        words_by = np.cumsum(np.add.reduceat(ends, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])), dtype=np.int64))
        return ranks, first[place], lengths, np.concatenate(([0], np.cumsum(lengths)))[words_by]

    def _fast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and for each text the place behind its last id."""
        ranks, first, lengths, behind = self._coded(texts)
        until = np.cumsum(lengths)
        place = np.repeat(first - (until - lengths).astype(np.int32), lengths)
        place += np.arange(len(place), dtype=np.int32)
        return self.ids[ranks[place]], behind

    def _plain(self, text: str) -> bool:
        """True if the fast way gives the library's ids."""
        if "\0" in text or ("<|" in text and self.special and self.special.search(text)):
            return False
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return max(text) < chr(FAST_LIMIT) and "İ" not in text

    def _ways(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Places of the texts that go the fast way, and of those that don't; empty ones are in neither."""
        fast, slow = [], []
        for i, t in enumerate(texts):
            if t:
                (fast if self._plain(t) else slow).append(i)
        return fast, slow

    def counts(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        out = np.zeros(len(texts), dtype=np.int64)
        fast, slow = self._ways(texts)
        if fast:
            out[fast] = np.diff(self._coded([texts[i] for i in fast])[3], prepend=0)
        for i in slow:
            out[i] = len(self.whole.encode(texts[i], add_special_tokens=False).ids)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (uint32), as encode(text, add_special_tokens=False) gives them."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        fast, slow = self._ways(texts)
        if fast:
            flat, ends = self._fast([texts[i] for i in fast])
            for i, part in zip(fast, np.split(flat, ends[:-1]), strict=True):
                out[i] = part
        for i in slow:
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``most`` characters, each with its first place; null becomes empty."""
    run, size, at = [], 0, 0
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= most or i == len(texts) - 1:
            yield at, run
            run, size, at = [], 0, i + 1


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 4096, kind_of_id: str = "<u4") -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian uint32, or as kind_of_id says), doc_tokens."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for at, part in chunks(texts):
                rows, starts, lengths, ids, totals = [], [], [], [], []
                for i, encoded in enumerate(bpe.encode(part)):
                    encoded = np.append(encoded, np.uint32(end_id))
                    for start in range(0, len(encoded), capacity):
                        piece = encoded[start : start + capacity]
                        rows.append(at + i)
                        starts.append(start)
                        lengths.append(len(piece))
                        ids.append(piece.astype(kind_of_id).tobytes())
                        totals.append(len(encoded))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())],
                    names=[id_col, "start", "length", "ids", "doc_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long")


def piece_lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096) -> DataFrame:
    """One row per piece, as :func:`tokenize` cuts them, without ids: id, start, length, doc_tokens."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            for at, part in chunks(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(bpe.counts(part) + 1)], names=[id_col, "doc_tokens"])

    counted = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, doc_tokens long")
    starts = counted.select(id_col, F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(capacity).cast("long"))).alias("start"), "doc_tokens")
    return starts.withColumn("length", F.least(F.col("doc_tokens") - F.col("start"), F.lit(capacity)))


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) with their counts: lengths longest first, each into the packs with most room.

    Packs that hold the same are one entry with a count, so the work follows the number of lengths, not of pieces.
    """
    heap: list[tuple[int, int, tuple[tuple[int, int], ...], int]] = []
    serial, done = 0, []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room, _, pattern, count = heapq.heappop(heap) if heap else (0, 0, (), 0)
            if -room < length:
                if count:
                    heapq.heappush(heap, (room, _, pattern, count))
                room, pattern, count = -capacity, (), left
            used = min(left, count)
            if used < count:
                serial += 1
                heapq.heappush(heap, (room, serial, pattern, count - used))
            same = pattern and pattern[-1][0] == length
            grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if same else (*pattern, (length, 1))
            serial += 1
            if -room == length:
                done.append((grown, used))
            else:
                heapq.heappush(heap, (room + length, serial, grown, used))
            left -= used
    return done + [(pattern, count) for _, _, pattern, count in heap]


def pattern_rows(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank behind, times, first sequence, offset): which ranks of a length go where."""
    rows, rank, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length, times in pattern:
            first = rank.get(length, 0)
            rows.append((length, first, first + count * times, times, sequence, offset))
            rank[length] = first + count * times
            offset += length * times
        sequence += count
    return rows


def pack(pieces: DataFrame, order: list[str], length_col: str = "length", capacity: int = 4096, rows_per_salt: int = 500_000, least_salts: int = 64, wide: DataFrame | None = None, ties: list[str] | None = None, tokens_per_salt: int = 4_000_000) -> DataFrame:
    """pieces (lengths 1 to capacity) with sequence_id and offset. ``order`` ranks pieces of one length; pieces should be a written table.

    wide: the same rows with further columns, which are placed in their stead; a salt then holds tokens_per_salt tokens of a length at most.
    ties: columns of the rows placed that rank those which are equal in ``order``.
    """
    spark = pieces.sparkSession
    by_length = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most ``capacity`` rows
    rules = pattern_rows(shortest_pack_first(by_length, capacity))
    bound = lambda length: rows_per_salt if wide is None else min(rows_per_salt, max(1, tokens_per_salt // length))
    salts = [max(least_salts, -(-by_length.get(length, 0) // bound(length))) for length in range(1, capacity + 1)]
    salt = F.pmod(F.xxhash64(*order), F.element_at(F.expr(f"array({','.join(map(str, salts))})"), F.col(length_col).cast("int")))
    placed = pieces if wide is None else wide
    salted = placed.withColumn("salt", salt)
    shifts = pieces.withColumn("salt", salt).groupBy(length_col, "salt").count().withColumn(
        "shift", F.sum("count").over(Window.partitionBy(length_col).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    )
    shifts = shifts.select(length_col, "salt", F.coalesce("shift", F.lit(0)).alias("shift"))
    local = F.row_number().over(Window.partitionBy(length_col, "salt").orderBy(*order, *(ties or []))) - 1
    ranked = salted.withColumn("local", local).join(shifts, [length_col, "salt"]).withColumn("rank", F.col("local") + F.col("shift"))
    table = spark.createDataFrame(rules or [], "rule_length long, low long, high long, times long, first_sequence long, first_offset long")
    # The table's size is bounded by the number of lengths, not by the corpus.
    ruled = ranked.join(F.broadcast(table), (F.col(length_col) == F.col("rule_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return ruled.select(
        *[F.col(c) for c in placed.columns],
        (F.col("first_sequence") + F.floor(nth / F.col("times")).cast("long")).alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("times") * F.col(length_col)).alias("offset"),
    )


def assembled(placed: DataFrame, id_col: str, capacity: int, pad_id: int, kind_of_id: str, rows: int = 1024) -> DataFrame:
    """Sequences of placed pieces (with ids): the pieces of a sequence meet in one task and are written at their offsets."""

    def build(held: pa.Table) -> Iterator[pa.RecordBatch]:
        """held: whole sequences, in order."""
        numbers = held.column("sequence_id").to_numpy()
        firsts = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1])))
        for at in range(0, len(firsts), rows):
            first = firsts[at : at + rows]
            part = held.slice(first[0], (firsts[at + rows] if at + rows < len(firsts) else len(numbers)) - first[0])
            flat = np.frombuffer(b"".join(part.column("ids").to_pylist()), dtype=kind_of_id)
            lengths, offsets = part.column("length").to_numpy(), part.column("offset").to_numpy()
            which = np.searchsorted(first - first[0], np.arange(len(lengths)), side="right") - 1
            out = np.full((len(first), capacity), pad_id, dtype="<u4")
            out.reshape(-1)[np.repeat(which * capacity + offsets - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))] = flat
            columns = [part.column(c).combine_chunks() for c in (id_col, "start", "length", "doc_tokens", "offset")]
            pieces = pa.StructArray.from_arrays(columns, names=["id", "start", "length", "doc_tokens", "offset"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers[first], pa.int64()),
                    pa.array(np.bincount(which, weights=lengths).astype(np.int64)),
                    pa.array([r.tobytes() for r in out], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.append(first - first[0], len(lengths)), pa.int32()), pieces),
                ],
                names=["sequence_id", "n_tokens", "ids", "pieces"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # pieces of sequences that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            numbers = held.column("sequence_id").to_numpy()
            whole = int(np.searchsorted(numbers == numbers[-1], True))  # the last sequence stays
            if whole:
                yield from build(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield from build(held)

    kind = placed.schema[id_col].dataType.simpleString()
    dealt = placed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return dealt.mapInArrow(run, f"sequence_id long, n_tokens long, ids binary, pieces array<struct<id:{kind},start:long,length:long,doc_tokens:long,offset:long>>")


def sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 4096, pad_id: int | None = None) -> DataFrame:
    """Documents to sequences: sequence_id, n_tokens, ids (``capacity`` little-endian uint32, pad_id or else end_id behind n_tokens), pieces.

    pieces: array of id, start, length, doc_tokens, offset. Ids are written once, numbered by piece, so that repeated rows and missing ids rank apart.
    """
    kind_of_id = "<u2" if max(end_id, int(word_bpe(tokenizer).ids.max()), word_bpe(tokenizer).whole.get_vocab_size()) < 1 << 16 else "<u4"
    number = "piece" if id_col != "piece" else "piece_"
    tokens = materialize(tokenize(docs, tokenizer, id_col, text_col, end_id, capacity, kind_of_id).withColumn(number, F.monotonically_increasing_id()), "tokens", "zstd")
    placed = pack(tokens.select(number, "length"), [number], "length", capacity, wide=tokens)
    return assembled(placed, id_col, capacity, end_id if pad_id is None else pad_id, kind_of_id)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Documents to pieces in sequences: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids on demand).

    Ids and their checksum are cut from the assembled sequence.
    """
    ids = lambda p: F.substr(F.col("ids"), (p["offset"] * 4 + 1).cast("int"), (p["length"] * 4).cast("int"))

    def cut(p: Column) -> Column:
        kept = [ids(p).alias("ids")] * keep_ids
        return F.struct(p["id"].alias(id_col), p["start"].alias("start"), p["length"].alias("length"), F.crc32(ids(p)).alias("ids_crc32"), p["doc_tokens"].alias("doc_tokens"), F.col("sequence_id").alias("sequence_id"), p["offset"].alias("offset"), *kept)

    made = sequences(docs, tokenizer, id_col, text_col, end_id, capacity)
    return made.select(F.inline(F.transform("pieces", cut)))
