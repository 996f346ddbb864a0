"""op3 against Python's re on hard and random texts."""

import random
import re

from gleanspark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s) if c.isdigit()]
    return sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(d)) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(m[0]) if kind == "card" else True, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


HARD = [
    None, "", "a@b.c", "a@b.c..x@d.e", "a@b.cc_x@d.e.f-", "@b.c a@b a@b. a.@b.c %@-.-", "x@y.z@w.v.u", "\U0001f600 me@ex.org \U0001f600 +1 (555) 010-9999.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.00255 1.2.3.999 9999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4111  1111 1111 1111", "5 4111111111111111", "+12345678 +123456789 +1-(2).3 456789012345 6", "1 2 3 4 5 6 7 8 9 0 " * 3000, "9" * 20000, "a.b" * 9000 + "@c" + ".d" * 9000, "." * 5000 + "@x.y", "+1" + " ((" * 4000, "x\x01@b.c a\x01.@b.c", "é@b.c", "4111111111111111\n4111111111111111",
]


def test_base_equals_python(spark):
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("a1@.-+ 0é_(") for _ in range(80)) for _ in range(600)] + ["".join(rng.choice("0123456789 -.+") for _ in range(120)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find_pii(docs).select("doc_id", pii.spans_text(pii.F.col("pii"), pii.BASE_KINDS).alias("s")).collect()}
    bad = [(texts[i] or "")[:100] for i in range(len(texts)) if got[i] != plain(texts[i])]
    assert not bad


def test_extras_context_and_redaction(spark):
    text = "My bank IBAN is GB82WEST12345698765432, not GB83WEST12345698765432. SSN: 078-05-1120; part 078-05-1120000. Mail me@ex.org or call +49 30 1234567."
    docs = spark.createDataFrame([(1, text, "p"), (2, "code 078-05-1120", "q")], "doc_id long, text string, kind string")
    rows = {r.doc_id: r for r in pii.find_pii(docs).withColumn("clean", pii.redact(pii.F.col("text"), pii.F.col("pii"))).collect()}
    got = rows[1].pii
    assert [s.value for s in got.iban] == ["GB82WEST12345698765432"] and got.iban[0].score == 1.0
    assert [s.value for s in got.ssn] == ["078-05-1120"] and rows[2].pii.ssn == []
    assert rows[1].clean == "My bank IBAN is [IBAN], not GB83WEST12345698765432. SSN: [SSN]; part 078-05-1120000. Mail [EMAIL] or call [PHONE]."
    assert rows[2].clean == rows[2].text and rows[1].kind == "p"
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_printed_ibans_context_behind_and_unions(spark):
    texts = {
        1: "Pay DE89 3704 0044 0532 0130 00 PLEASE, FR14 2004 1010 0505 0001 3M02 606 GB82 WEST 1234 5698 7654 32 OK, not DE88 3704 0044 0532 0130 00.",
        2: "123-45-6789 is my SSN",
        3: "+1 415 555 0100john@x.com now",
        4: "DE89370400440532013000 NO93 8601 1117 947",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_pii(docs).withColumn("clean", pii.redact(pii.F.col("text"), pii.F.col("pii"))).collect()}
    assert rows[1].clean == "Pay [IBAN] PLEASE, [IBAN] [IBAN] OK, not DE88 3704 0044 0532 0130 00."
    assert all(texts[1][s.start : s.end] == s.value for s in rows[1].pii.iban)
    assert rows[2].clean == "[SSN] is my SSN"
    assert rows[3].clean == "[PHONE] now"
    assert rows[4].clean == "[IBAN] [IBAN]"
