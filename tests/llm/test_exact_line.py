"""op6 and op7 against brute force."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from gleanspark.llm import exact_dedup, line_dedup

ROWS = [
    (5, "a  b\n", "x"), (2, "a b ", "y"), (9, "a\t\x0bb ", "z"), (3, "A b", "x"), (4, None, "n"), (1, "", "n"), (7, " ", "n"), (None, "A b", "q"), (6, "é b", "u"), (6, "é b", "u"), (8, "é b", "u"),
    (10, "long " * 50_000, "l"),
]


def test_exact_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string").repartition(3)
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in ROWS]
    want = []
    for (i, _, _), n in zip(ROWS, norm, strict=True):
        ids = [j for (j, _, _), m in zip(ROWS, norm, strict=True) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_digest_collisions_are_told_apart(spark, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(real(c, n), 1, 1))
    rows = [(i, f"text {i % 40}") for i in range(120)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, i % 40, 3) for i in range(120)} and len(got) == 120


def plain_lines(texts, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and counts[key(x)] >= least)]
        yield len(lines), len(lines) - len(kept), "\n".join(kept)


def test_lines_equal_brute_force(spark):
    texts = [None, "", "\n\n", "Hot Line\nown 1\n\n", " hot line\t\nÉ Up\nown 2", "HOT LINE", "é up", "É UP\nÉ up", "own 3\nhot line\nhot line\ntail", "hot line\n" * 3000 + "end", "É up\nhot line", "x\ry\nHOT LINE\r"]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(4, texts[4], 99), (None, texts[5], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, drops long").repartition(3)
    for bound in (0, 1000):
        got = line_dedup.line_dedup(docs, min_docs=3, broadcast_keys=bound).collect()
        want = list(plain_lines([r[1] for r in rows], 3))
        found = sorted((str(r.doc_id), r.drops, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.text) for r in got)
        assert found == sorted((str(r[0]), r[2], *w) for r, w in zip(rows, want, strict=True))
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
