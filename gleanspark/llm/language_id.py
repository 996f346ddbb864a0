"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point and a seed. An n-gram's vector binds its letters'
vectors, each permuted (rolled) by its place, by elementwise product; a document's vector bundles (adds) the vectors of
all its n-grams; a language's prototype bundles the unit vectors of its training documents. A document gets the language
whose prototype has the largest cosine with it.

A chunk of documents is a matrix product: counts of the distinct n-grams by document, times the n-grams' vectors, in blocks of
n-grams, so that texts of many scripts need no more memory than others. Training adds
up at most one vector per language and task, then one per language: the data meets in sums only.

Letters are what Unicode calls letters, in lower case; any run of other characters is one boundary symbol, which also stands before
the first and after the last letter.

Defined cases: a null text, or one without letters, is ``und`` with score 0; rows without label or id are not learned from; with
nothing to learn from, all texts are ``und``; ties go to the language that comes first in order; repeated rows are treated row by row;
an empty table gives an empty result; very long texts are counted whole, piece by piece; other columns pass through ``predict``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.packing import chunks
from gleanspark.session import ship

DIMENSIONS = 1024
GRAM = 3
CHUNK = 1_500_000
GRAMS = 8192
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True at the code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def letter_vectors(points: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Rows of +1 and -1 (int8), each a function of its code point and the seed alone."""
    rows = [np.random.default_rng((seed, int(p))).integers(0, 2, dimensions, dtype=np.int8) for p in points]
    return np.array(rows, dtype=np.int8).reshape(len(points), dimensions) * 2 - 1


def _cut(text: str, most: int) -> list[str]:
    """text in pieces of about ``most`` characters that begin at non-letters, so that they hold the same n-grams as the whole."""
    out, at = [], 0
    while len(text) - at > most:
        end = next((i for i in range(at + most, at, -1) if not text[i].isalpha()), 0) or next((i for i in range(at + most, len(text)) if not text[i].isalpha()), len(text))
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def document_vectors(texts: list[str], dimensions: int = DIMENSIONS, seed: int = 1, most: int = CHUNK) -> np.ndarray:
    """The bundled n-gram vectors of texts (float32), one row each; a text without letters has a zero row.

    Texts longer than ``most`` are added up piece by piece.
    """
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    for at, part in chunks([t.lower() for t in texts], most):
        if len(part[-1]) <= most:
            out[at : at + len(part)] = _vectors(part, dimensions, seed)
            continue
        if len(part) > 1:
            out[at : at + len(part) - 1] = _vectors(part[:-1], dimensions, seed)
        for piece in _cut(part[-1], most):
            out[at + len(part) - 1] += _vectors([piece], dimensions, seed)[0]
    return out


def _vectors(texts: list[str], dimensions: int, seed: int) -> np.ndarray:
    joined = " ".join(texts)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    points = np.frombuffer(f" {joined} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    owner = np.concatenate(([0], owner))[: len(points)]
    is_letter = _letters()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the boundary behind a word
    keep[0] = True
    symbols = np.where(is_letter, points, 0)[keep]
    owner = owner[keep]
    present = np.zeros(0x110000, dtype=bool)
    present[symbols] = True
    known = np.flatnonzero(present)
    order = np.zeros(known[-1] + 1, dtype=np.int64)
    order[known] = np.arange(len(known))
    place = order[symbols]
    base = len(known)
    code = place[:-2] * base * base + place[1:-1] * base + place[2:]
    # A gram belongs to the document of its middle symbol if that is a letter; grams about a boundary say nothing new.
    inner = symbols[1:-1] != 0
    code, owner = code[inner], owner[1:-1][inner]
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    if not len(code):
        return out
    if base**3 <= 4_000_000:
        seen = np.zeros(base**3, dtype=bool)
        seen[code] = True
        grams = np.flatnonzero(seen)
        index = (np.cumsum(seen) - 1)[code]
    else:
        grams, index = np.unique(code, return_inverse=True)
    vectors = letter_vectors(known, dimensions, seed)
    second, first_ = np.roll(vectors, 1, axis=1), np.roll(vectors, 2, axis=1)
    # A block of n-grams at a time, so that memory doesn't follow their number.
    blocks = index // GRAMS
    order = np.argsort(blocks, kind="stable") if len(grams) > GRAMS else slice(None)
    index, owner = index[order], owner[order]
    borders = np.searchsorted(blocks[order], np.arange(len(grams) // GRAMS + 2))
    for block in range(len(grams) // GRAMS + 1):
        held = grams[block * GRAMS : (block + 1) * GRAMS]
        inside = slice(borders[block], borders[block + 1])
        own_index, own = index[inside] - block * GRAMS, owner[inside]
        if not len(own):
            continue
        bound = (first_[held // base**2] * second[held // base % base] * vectors[held % base]).astype(np.float32)
        step = max(1, 8_000_000 // len(held))
        starts = np.searchsorted(own, np.arange(0, len(texts) + step, step))
        for i, first in enumerate(range(0, len(texts), step)):
            part = slice(starts[i], starts[i + 1])
            rows = min(step, len(texts) - first)
            counts = np.bincount((own[part] - first) * len(held) + own_index[part], minlength=rows * len(held)).reshape(rows, len(held))
            out[first : first + rows] += counts.astype(np.float32) @ bound
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = 1) -> tuple[list[str], np.ndarray]:
    """Labels in order, and their prototypes as unit rows. One small row per language reaches the driver."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for at, part in chunks(batch.column(0).to_pylist(), CHUNK):
                vectors = _unit(document_vectors(part, dimensions, seed))
                own = np.array(labels[at : at + len(part)])
                for label in np.unique(own):
                    sums[label] = sums.get(label, np.zeros(dimensions)) + vectors[own == label].sum(axis=0, dtype=np.float64)
        if sums:
            flat = pa.array(np.round(np.concatenate(list(sums.values())) * 1e6).astype(np.int64))
            place = pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(sums)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(sums), dimensions)), place, flat], names=["label", "place", "value"])

    learned = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col), F.col(label_col).cast("string"))
    parts = learned.mapInArrow(run, "label string, place int, value long")
    # Whole numbers add up to the same in any order.
    sums = parts.groupBy("label", "place").agg(F.sum("value").alias("value"))
    rows = sums.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("vector")).orderBy("label").collect()
    labels = [r.label for r in rows]
    matrix = np.array([[v.value for v in r.vector] for r in rows], dtype=np.float32).reshape(len(rows), dimensions)
    return labels, _unit(matrix)


def predict(docs: DataFrame, labels: list[str], prototypes: np.ndarray, text_col: str = "text", seed: int = 1, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with pred_col and score_col: the cosine with the chosen prototype, cut to 0..1."""
    ship(docs.sparkSession)
    dimensions = prototypes.shape[1]
    known = docs.sparkSession.sparkContext.broadcast(prototypes)  # languages x dimensions
    new = {pred_col.lower(), score_col.lower()}
    kept = [c for c in docs.columns if c.lower() not in new]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch.column(1).to_pylist(), CHUNK):
                vectors = document_vectors(part, dimensions, seed)
                names, scores = [UNKNOWN] * len(part), np.zeros(len(part))
                if labels:
                    cosines = _unit(vectors) @ known.value.T
                    best = cosines.argmax(axis=1)
                    some = np.abs(vectors).sum(axis=1) > 0
                    names = [labels[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                    scores = np.where(some, np.clip(cosines.max(axis=1), 0, 1), 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["row", "pred", "score"])

    found = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, pred string, score double")
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("pred").alias(pred_col), F.col("score").alias(score_col))
