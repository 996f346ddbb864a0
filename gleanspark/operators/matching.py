"""Box matching, drift between runs, confusion matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions.geometry import iou
from gleanspark.session import materialize


def box_pairs(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.3, cell: float = 0.25, hot: int = 2000) -> DataFrame:
    """Pairs (a_id, b_id, iou) of boxes of the same keys that overlap by least or more: boxes meet in the first tile that both touch.

    A tile of more than ``hot`` left boxes is salted: its left boxes are dealt out and its right ones go to every salt.
    """
    first = lambda at: F.floor(F.col(at) / cell)
    tiles = lambda at, size: F.sequence(first(at), F.floor((F.col(at) + F.greatest(F.col(size), F.lit(0.0))) / cell))
    tile = [*keys, "_tx", "_ty"]

    def tiled(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("id", "x", "y", "w", "h")]).distinct()
        return named.withColumn("_tx", F.explode(tiles(f"{p}_x", f"{p}_w"))).withColumn("_ty", F.explode(tiles(f"{p}_y", f"{p}_h")))

    a, b = tiled(left, "a"), tiled(right, "b")
    salts = a.groupBy(*tile).count().where(F.col("count") > hot).select(*tile, F.ceil(F.col("count") / hot).alias("_salts"))
    count = F.coalesce("_salts", F.lit(1))
    a = a.join(salts, tile, "left").withColumn("_salt", F.pmod(F.xxhash64("a_id"), count)).drop("_salts")
    b = b.join(salts, tile, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).drop("_salts")
    once = (F.col("_tx") == F.greatest(first("a_x"), first("b_x"))) & (F.col("_ty") == F.greatest(first("a_y"), first("b_y")))
    overlap = iou(*[F.col(f"a_{c}") for c in "xywh"], *[F.col(f"b_{c}") for c in "xywh"])
    return a.join(b, [*tile, "_salt"]).where(once).select(*keys, "a_id", "b_id", overlap.alias("iou")).where(F.col("iou") >= least)


def greedy_match(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """keys..., a_id, b_id (null: unmatched), iou: in order of ``ord`` each left box takes the best unclaimed right one; the first wins ties.

    left, right: keys..., id, ord, x, y, w, h. Boxes claim in rounds of joins and aggregates: each left box asks for the best right box it
    still has a pair with, each right box holds the earliest that asks, and its pairs with later left boxes go for good. A holder is only
    ever replaced by an earlier left box, so when no request is turned down, the holders are those of the serial order.
    """

    def ranks(df: DataFrame, p: str) -> DataFrame:
        order = F.min(F.struct(F.col("ord").isNull().alias("none"), F.col("ord").alias("ord")))
        return df.groupBy(*keys, F.col("id").alias(f"{p}_id")).agg(order.alias("_o")).select(*keys, f"{p}_id", F.struct("_o.none", "_o.ord", F.col(f"{p}_id").alias("id")).alias(f"{p}_rank"))

    pairs = box_pairs(left, right, keys, least).join(ranks(left, "a"), [*keys, "a_id"]).join(ranks(right, "b"), [*keys, "b_id"])
    live = materialize(pairs, "box-pairs")
    while True:
        best = live.groupBy(*keys, "a_id").agg(F.min(F.struct((-F.col("iou")).alias("cost"), "b_rank", "a_rank")).alias("m"))
        asked = materialize(best.select(*keys, "a_id", F.col("m.b_rank.id").alias("b_id"), (-F.col("m.cost")).alias("iou"), F.col("m.a_rank").alias("a_rank")), "box-claims")
        holders = asked.groupBy(*keys, "b_id").agg(F.min("a_rank").alias("holder"), F.count("*").alias("n"))
        if holders.where("n > 1").isEmpty():
            break
        live = materialize(live.join(holders.drop("n"), [*keys, "b_id"], "left").where("holder IS NULL OR a_rank <= holder").drop("holder"), "box-pairs")
    every = left.select(*keys, F.col("id").alias("a_id"))
    return every.join(asked.drop("a_rank"), [*keys, "a_id"], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def best_match(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """keys..., a_id, b_id, iou: each left box with its best right one, which several may share."""
    nth = F.row_number().over(Window.partitionBy(*keys, "a_id").orderBy(F.desc("iou"), "b_id"))
    best = box_pairs(left, right, keys, least).withColumn("nth", nth).where("nth = 1").drop("nth")
    return left.select(*keys, F.col("id").alias("a_id")).join(best, [*keys, "a_id"], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def drift(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement over all originals, recall of high priorities, mean IoU of the matched. matches: b_id, iou, a_type, b_type, a_priority, b_priority."""
    share = lambda cond, among: F.avg(F.when(among, F.coalesce(cond, F.lit(False)).cast("double")))
    found = F.col("b_id").isNotNull()
    one = F.lit(1.0)
    return matches.groupBy(*keys).agg(
        F.count("*").alias("originals"),
        F.coalesce(share(found & (F.col("a_type") == F.col("b_type")), F.lit(True)), one).alias("type_agreement"),
        F.coalesce(share(found & (F.col("a_priority") == F.col("b_priority")), F.lit(True)), one).alias("priority_agreement"),
        F.coalesce(share(found, F.col("a_priority") == "high"), one).alias("high_recall"),
        F.coalesce(F.avg(F.when(found, F.col("iou"))), one).alias("mean_iou"),
    )


def confusion(df: DataFrame, truth: Column, guess: Column, keys: list[str] | None = None, known: list[str] | None = None) -> DataFrame:
    """keys..., gt, pred, n. Labels outside ``known`` count as UNKNOWN."""
    label = lambda c: F.when(c.isin(known), c).otherwise("UNKNOWN") if known else c
    return df.groupBy(*(keys or []), label(truth).alias("gt"), label(guess).alias("pred")).agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys..., label, support, precision, recall, f1, iou; null where the denominator is 0."""
    keys = keys or []
    same = F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)
    by_truth = matrix.select(*keys, F.col("gt").alias("label"), F.col("n").alias("s"), F.lit(0).alias("g"), same.alias("t"))
    by_guess = matrix.select(*keys, F.col("pred").alias("label"), F.lit(0).alias("s"), F.col("n").alias("g"), F.lit(0).alias("t"))
    sums = by_truth.unionByName(by_guess).groupBy(*keys, "label").agg(F.sum("s").alias("support"), F.sum("g").alias("guessed"), F.sum("t").alias("hits"))
    over = lambda a, b: a / F.nullif(b, F.lit(0))
    hits, support, guessed = (F.col(c).cast("double") for c in ("hits", "support", "guessed"))
    return sums.select(*keys, "label", "support", over(hits, guessed).alias("precision"), over(hits, support).alias("recall"), over(2 * hits, support + guessed).alias("f1"), over(hits, support + guessed - hits).alias("iou"))


def summary(scores: DataFrame, matrix: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys..., accuracy, miou, macro_f1; means over labels with support only."""
    keys = keys or []
    supported = F.col("support") > 0
    means = scores.groupBy(*keys).agg(F.avg(F.when(supported, F.col("iou"))).alias("miou"), F.avg(F.when(supported, F.col("f1"))).alias("macro_f1"))
    right = matrix.groupBy(*keys).agg((F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return means.join(right, keys) if keys else means.crossJoin(right)  # one row each
