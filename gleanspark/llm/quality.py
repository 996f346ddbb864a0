"""Quality classification by a sparse rule ensemble.

Statistics of a text (native columns) feed a random forest of shallow trees; every path from a root to a node is a
conjunctive rule; a lasso logistic regression gives most rules no weight; the rules left and their weights become one Spark column
expression, so that scoring is a projection without Python.

The fit takes at most ``max_fit_rows`` labelled rows, those with the smallest hash of their id: the documented bound of the
classifier's sample. Scoring covers every row and whole texts.

Defined cases: a null text is scored as the empty text; ids labelled more than once count once, with the smaller label; null labels
and ids are not learned from; with labels of one kind only, or none, the score is that kind's share (0.5 without any); ties and
repeated rows are scored alike; an empty table gives an empty result; very long texts are scored whole; other columns pass through
``score``, but those named as its two results are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.session import materialize

MAX_FIT_ROWS = 20_000
FIT_TASKS = 4
Condition = tuple[str, bool, float]  # statistic, True for <=, threshold


def statistics(text: Column) -> dict[str, Column]:
    """Name to column of double: shares and means, all defined for the empty text."""
    body = F.coalesce(text, F.lit(""))
    n = F.char_length(body)
    words = F.split(body, r"[\s]+")
    lines = F.split(body, "\n", -1)
    share = lambda pattern: F.regexp_count(body, F.lit(pattern)) / F.greatest(n, F.lit(1))
    distinct = lambda a: F.size(F.array_distinct(a)) / F.greatest(F.size(a), F.lit(1))
    return {
        "log_chars": F.log1p(n.cast("double")),
        "symbols": share(r"[#$%&*|<>{}~^\\]"),
        "marks": share("[!?]"),
        "stops": share("[.,;:]"),
        "upper": share("[A-Z]"),
        "digits": share("[0-9]"),
        "word_chars": n / F.greatest(F.size(words), F.lit(1)),
        "line_chars": n / F.greatest(F.size(lines), F.lit(1)),
        "stutter": F.regexp_count(body, F.lit(r"(?<!\S)(\S++)(?=\s++\1(?!\S))")) / F.greatest(F.size(words), F.lit(1)),
        "distinct_lines": distinct(lines),
    }


@dataclass(frozen=True)
class RuleModel:
    """intercept + sum of weights of the rules that hold, through the logistic function."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self) -> Column:
        """The score as an expression over columns named as the statistics."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, below, threshold in conditions:
                holds = holds & ((F.col(name) <= threshold) if below else (F.col(name) > threshold))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _paths(node, names: list[str], so_far: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:  # noqa: ANN001
    """The conditions of every node below the root, the tightest per statistic and side."""
    found = [so_far] if so_far else []
    if node.subtreeDepth() == 0:
        return found
    name, threshold = names[node.split().featureIndex()], node.split().threshold()
    for child, below in ((node.leftChild(), True), (node.rightChild(), False)):
        tight = tuple(c for c in so_far if c[:2] != (name, below)) + ((name, below, threshold),)
        found += _paths(child, names, tuple(sorted(tight)))
    return found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_fit_rows: int = MAX_FIT_ROWS, trees: int = 20, depth: int = 3, lasso: float = 0.002, tolerance: float = 1e-4, seed: int = 1) -> RuleModel:
    """Learn label_col (0 or 1) of ``labels`` from the texts of ``docs``."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_fit_rows)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    stats = statistics(F.col("text"))
    names = list(stats)
    rows = materialize(found.select("label", *[c.cast("double").alias(k) for k, c in stats.items()]), "quality-fit")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        share = (ones + 0.5) / (n + 1)
        return RuleModel(math.log(share / (1 - share)), ())
    rows = VectorAssembler(inputCols=names, outputCol="stats").transform(rows.coalesce(FIT_TASKS))  # max_fit_rows rows at most, in many small steps
    forest = RandomForestClassifier(featuresCol="stats", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=seed).fit(rows)
    rules = sorted({p for tree in forest.trees for p in _paths(tree._call_java("rootNode"), names)})
    if not rules:
        return RuleModel(math.log(ones / (n - ones)), ())

    def holds(conditions: tuple[Condition, ...]) -> Column:
        out = F.lit(True)
        for name, below, threshold in conditions:
            out = out & ((F.col(name) <= threshold) if below else (F.col(name) > threshold))
        return out.cast("double")

    matrix = rows.select("label", *[holds(r).alias(f"r{i}") for i, r in enumerate(rules)])
    matrix = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(matrix).select("label", "rules").cache()
    try:
        linear = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=100, tol=tolerance).fit(matrix)
    finally:
        matrix.unpersist()
    weights = linear.coefficients.toArray()
    return RuleModel(float(linear.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w != 0))


def score(docs: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with score_col (0 to 1) and predicted_col (1 from 0.5 on)."""
    kept = [c for c in docs.columns if c.lower() not in (score_col.lower(), predicted_col.lower())]
    stats = docs.select(F.struct(*kept).alias("row"), *[c.cast("double").alias(k) for k, c in statistics(F.col(text_col)).items()])
    # A generator of one row is a fence: a later filter on the score doesn't compute the statistics again for each rule.
    scored = stats.select("row", F.explode(F.array(model.column())).alias("quality_score"))
    return scored.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("quality_score").alias(score_col), (F.col("quality_score") >= 0.5).cast("int").alias(predicted_col))
