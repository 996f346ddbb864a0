"""Line deduplication in DataFrame functions only.

Texts are split at ``\\n``. A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in
lower case. Keys are hashed to 128 bits; the distinct documents of each hash are counted, and
keys of at least ``min_chars`` code points found in ``min_docs`` documents or more lose all their lines
everywhere. What stays is joined by ``\\n`` in the old order.

Only hashes, ids and positions are shuffled to count and to find lines; the texts move once, when each meets
its own list of positions. That list is keyed by document (id and text together), and rows that repeat one document often are answered where
they lie (``lookup.spread_lookup``), so neither hot texts nor repeated rows are hot keys; counting goes by (hash, id) first, so a hot line isn't one either. The frequent keys are broadcast when
their counted number is at most ``broadcast_keys`` (16 bytes each), else joined by shuffle.

Defined cases: null and empty texts are one empty line; an empty key is never dropped (``min_chars`` >= 1);
rows with the same id are one document for the count, rows without id one each, and every row loses its lines
itself; ids may be of any type, and hold newlines; a document that loses all lines keeps the empty text; an empty table gives an
empty result; very long texts are split whole; other columns pass through, whatever their names, but one named as ``out`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.operators.lookup import spread_lookup
from gleanspark.session import materialize

#: The characters stripped from both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    stripped = F.trim(line, F.lit(STRIPPED))
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def document_key(id_col: Column, text: Column) -> Column:
    """128 bits of id and text, each hashed apart: equal rows share it, and they lose the same lines."""
    ident = F.coalesce(F.md5(id_col.cast("string")), F.lit(""))  # as long as no hash is
    return F.unhex(F.md5(F.concat(ident, F.md5(F.coalesce(text, F.lit(""))))))


def frequent_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(h): hashes of the keys found in at least min_docs documents."""
    own = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    numbered = docs.select(F.col(id_col).alias("id"), own.alias("row"), F.col(text_col).alias("body"))
    keys = numbered.select("id", "row", F.explode(F.array_distinct(F.transform(lines_of(F.col("body")), line_key))).alias("key"))
    found = keys.where(F.char_length("key") >= min_chars).select(key_hash(F.col("key")).alias("h"), "id", "row").distinct()
    return found.groupBy("h").count().where(F.col("count") >= min_docs).select("h")


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    broadcast_keys: int = 500_000,
    out: str = "line_dedup",
) -> DataFrame:
    """docs with text replaced by what stays, and n_lines, n_dropped appended as columns of struct ``out``."""
    frequent = materialize(frequent_keys(docs, id_col, text_col, min_docs, min_chars), "line-keys")
    if frequent.count() <= broadcast_keys:
        frequent = F.broadcast(frequent)
    text, ident = F.col(text_col), F.col(id_col)
    hashed = F.transform(lines_of(text), lambda line: key_hash(line_key(line)))
    hits = docs.select(document_key(ident, text).alias("k"), F.posexplode(hashed).alias("pos", "h")).join(frequent, "h", "left_semi")
    drops = hits.groupBy("k").agg(F.collect_set("pos").alias("drops"))
    counts = docs.groupBy(document_key(ident, text).alias("k")).agg(F.count("*").alias("n"))
    told = materialize(counts.join(drops, "k", "left"), "line-drops")
    rows = spread_lookup(docs.select(F.struct("*").alias("row"), text.alias("body"), document_key(ident, text).alias("k")), told, "k", "n")

    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    # The outer transform binds the split lines once, so that they are not split anew for each place.
    body = F.when(F.col("drops").isNull(), F.coalesce("body", F.lit(""))).otherwise(F.get(F.transform(F.array(lines_of(F.col("body"))), kept), F.lit(0)))
    counts = F.struct(
        F.size(lines_of(F.col("body"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    fields = [body.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != out.lower()]
    return rows.select(*fields, counts.alias(out))
