"""Tables that op12 no longer reads are gone while it still runs."""

from pathlib import Path

from gleanspark.llm.substring_dedup import substring_dedup
from gleanspark.session import scratch


def test_places_are_discarded(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, f"c {passage} d"), (3, "short")], "doc_id long, text string")
    found = substring_dedup(docs)
    lying = [p.name for p in Path(scratch(spark).removeprefix("file:")).iterdir()]
    assert not [n for n in lying if n.startswith(("segments-", "distinct-segments-"))]
    assert {r.doc_id: r.substring_dedup.n_removed for r in found.collect()} == {1: 40, 2: 40, 3: 0}
