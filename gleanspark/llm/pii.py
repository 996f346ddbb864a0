"""Personal data, in DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) confirm them, and words nearby adjust the
score. Base kinds are email, ip, card and phone, leftmost and non-overlapping per kind; a match that
fails its check is dropped and nothing inside it is tried again. The method adds ``iban`` (mod 97; unbroken or with single spaces)
and ``ssn`` (only with a context word before or after it). Offsets are code points, ends exclusive.

Spark gives no offsets of matches, so a text is both split at a pattern and matched by it: the lengths of
gaps and matches, added up, are the offsets, and the context is cut from the neighbouring gaps and matches. No step copies
what was found so far, or walks the text, for each match, so that a text of 100,000 matches takes seconds. Every pattern here repeats single character classes
only, or groups a bounded number of times, so that neither a long run of digits nor one of dots can
exhaust Java's stack or take quadratic time.

Defined cases: null and empty texts have no spans; repeated rows and ids are treated row by row; an empty
table gives an empty result; very long texts are searched whole; other columns pass through, but one named as ``out`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn")
SPAN = "struct<kind:string,start:int,end:int,value:string,score:double>"

#: Length of an IBAN by country, as registered: a printed one with single spaces ends there, whatever word follows.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_PRINTED = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}(?![A-Za-z0-9])" for length, codes in IBAN_LENGTHS.items())

#: Patterns. A maximal run of 13 to 19 digits with single separators is what the greedy, unbounded card pattern
#: leaves after its check; dots that no label follows are masked by \x01 before e-mail addresses are matched.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{_PRINTED})|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}+)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Cheap tests that spare most texts the pattern.
HINTS = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": r"\bip\b|host|server|address",
    "card": "card|visa|credit|payment|account",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security|number",
}


def running(values: Column, op) -> Column:  # noqa: ANN001
    """Each place's ``op`` (associative) over all values up to it. Blocks of about the root of the size keep copying of arrays small."""
    empty = F.array().cast("array<int>")

    def prefixes(block: Column) -> Column:
        last = lambda a: F.element_at(a, -1)
        return F.aggregate(block, empty, lambda a, v: F.array_append(a, F.when(F.size(a) == 0, v).otherwise(op(last(a), v))))

    def over(blocks: Column) -> Column:
        ends = prefixes(F.transform(blocks, lambda b: F.element_at(b, -1)))
        shift = lambda end: lambda b, j: F.when(j == 0, b).otherwise(F.transform(b, lambda v: op(F.get(end, j - 1), v)))
        return F.flatten(bound(ends, lambda end: F.transform(blocks, shift(end))))

    def whole(values: Column, step: Column) -> Column:
        n = F.size(values)
        starts = F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int"))
        return bound(F.transform(starts, lambda j: prefixes(part(values, j * step, F.least(j * step + step, n) - 1))), over)

    size_of_block = lambda v: F.ceil(F.sqrt(F.size(v))).cast("int")
    return F.when(F.size(values) > 0, bound(values, lambda v: bound(size_of_block(v), lambda step: whole(v, step)))).otherwise(empty)


def part(values: Column, first: Column, last: Column) -> Column:
    """The values at places first to last, which must exist. F.slice would go over the whole array."""
    return F.transform(F.sequence(first, last), lambda i: F.get(values, i))


def bound(value: Column, f) -> Column:  # noqa: ANN001
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _matches(text: Column, kind: str, context_chars: int) -> Column:
    """array<struct<start,end,value,near>> of the pattern's matches in text, offsets in code points; near: the text about the match, which a bar stands for."""
    source = text
    if kind == "email":
        source = F.regexp_replace(F.translate(text, "\x01", "\x02"), r"\.(?![A-Za-z0-9-])", "\x01")
    found = F.regexp_extract_all(source, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(source, PATTERNS[kind], -1)
    # Matches are at least four code points long, so that few neighbours hold the context.
    pairs = -(-context_chars // 4)

    def spans(gaps: Column, found: Column) -> Column:
        sizes = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda x: F.char_length(x["gap"]) + F.coalesce(F.char_length(x["value"]), F.lit(0)))
        edge = lambda cut: F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda x: cut(x))
        heads = edge(lambda x: F.concat(F.left(x["gap"], F.lit(context_chars)), F.left(F.coalesce(x["value"], F.lit("")), F.lit(context_chars))))
        tails = edge(lambda x: F.concat(F.right(x["gap"], F.lit(context_chars)), F.right(F.coalesce(x["value"], F.lit("")), F.lit(context_chars))))

        def span(ends: Column, heads: Column, tails: Column) -> Column:
            def made(value: Column, i: Column) -> Column:
                end = F.get(ends, i)
                first = F.greatest(i - pairs, F.lit(0))
                before = F.array_join(F.transform(F.sequence(first, i), lambda j: F.when(j < i, F.get(tails, j)).otherwise(F.right(F.get(gaps, j), F.lit(context_chars)))), "")
                after = F.array_join(part(heads, i + 1, F.least(i + 1 + pairs, F.size(found))), "")
                near = F.concat(F.right(before, F.lit(context_chars)), F.lit("|"), F.left(after, F.lit(context_chars)))
                return F.struct((end - F.char_length(value)).alias("start"), end.alias("end"), F.translate(value, "\x01", ".").alias("value"), near.alias("near"))

            return F.transform(found, made)

        ends = running(sizes, lambda a, b: a + b)
        return bound(ends, lambda e: bound(heads, lambda h: bound(tails, lambda t: span(e, h, t))))

    none = F.array().cast("array<struct<start:int,end:int,value:string,near:string>>")
    return F.when(text.rlike(HINTS[kind]), bound(gaps, lambda g: bound(found, lambda v: spans(g, v)))).otherwise(none)


def luhn(value: Column) -> Column:
    """True where the digits of value pass Luhn's check."""
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    each = F.transform(F.split(digits, ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """True where value, single spaces aside, is an IBAN by ISO 7064 mod 97-10."""
    value = F.translate(value, " ", "")
    moved = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        digit = F.ascii(c) - 48
        return F.when(c == "", a).when(digit < 10, (a * 10 + digit) % 97).otherwise((a * 100 + digit - 7) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    digits = F.char_length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.coalesce(F.substr(part(p), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    return {"card": lambda: luhn(value), "phone": lambda: digits.between(9, 15), "iban": lambda: mod97(value)}.get(kind, lambda: F.lit(True))()


def spans_of(text: Column, kind: str, context_chars: int = 40) -> Column:
    """array<SPAN> of one kind, in the order of the text."""

    def scored(m: Column) -> Column:
        score = F.when(F.lower(m["near"]).rlike(CONTEXT[kind]), F.lit(min(1.0, PRIOR[kind] + 0.3))).otherwise(F.lit(PRIOR[kind]))
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), score.alias("score"))

    return F.transform(F.filter(_matches(text, kind, context_chars), lambda m: _confirmed(kind, m["value"])), scored)


def find_pii(docs: DataFrame, text_col: str = "text", extra_score: float = 0.6, out: str = "pii") -> DataFrame:
    """docs with ``out``: struct of one array<SPAN> per kind. Spans of extra kinds need a score of extra_score."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = [spans_of(text, k).alias(k) for k in BASE_KINDS]
    extra = [F.filter(spans_of(text, k), lambda s: s["score"] >= extra_score).alias(k) for k in EXTRA_KINDS]
    kept = [F.col(c) for c in docs.columns if c.lower() != out.lower()]
    return docs.select(*kept, F.struct(*base, *extra).alias(out))


def cut(blocks: Column, first: Column, behind: Column, block: int) -> Column:
    """The code points from first up to behind of a text given as blocks; costs what the piece is long, wherever it lies."""
    at = F.floor(first / block).cast("int")
    held = F.array_join(part(blocks, at, F.floor(behind / block).cast("int")), "")  # the block behind the last is null, and left out
    return F.substr(held, first - at * block + 1, behind - first)


def redact(text: Column, pii: Column, block: int = 512) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced together, by the kind of the earliest and then longest."""
    kinds = (*BASE_KINDS, *EXTRA_KINDS)
    order = F.array(*[F.lit(k) for k in kinds])
    slim = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), F.array_position(order, s["kind"]).alias("kind"))
    spans = F.array_sort(F.transform(F.flatten(F.array(*[pii[k] for k in kinds])), slim))
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{block}}}"), F.lit(0))

    def replaced(spans: Column, reach: Column, fresh: Column, blocks: Column) -> Column:
        """reach: the furthest end so far; fresh: places of the spans that begin behind all earlier ones."""

        def piece(i: Column, nth: Column) -> Column:
            span = F.get(spans, i)
            before = F.when(nth == 0, F.lit(0)).otherwise(F.get(reach, i - 1))
            return F.concat(cut(blocks, before, span["start"], block), F.lit("["), F.upper(F.get(order, span["kind"].cast("int") - 1)), F.lit("]"))

        rest = cut(blocks, F.element_at(reach, -1), F.char_length(text), block)
        return F.concat(F.array_join(F.transform(fresh, piece), ""), rest)

    def starts(spans: Column, reach: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(spans) - 1)
        return F.filter(places, lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(reach, i - 1)))

    def merged(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: -s["minus_end"]), F.greatest)
        return bound(reach, lambda r: bound(starts(spans, r), lambda f: bound(blocks, lambda b: replaced(spans, r, f, b))))

    some = F.aggregate(F.array(*[F.size(pii[k]) for k in kinds]), F.lit(0), lambda a, n: a + n) > 0
    return F.when(some, bound(spans, merged)).otherwise(text)


def spans_text(pii: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the kinds' spans, by kind as listed and then start, comma-joined."""
    every = F.flatten(F.array(*[pii[k] for k in kinds]))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
