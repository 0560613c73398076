"""Scores against labels: recall and precision, per group and in total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(rows: DataFrame, group: str) -> DataFrame:
    """group (null: total), tp, fp, fn, recall, precision of rows (predicted, actual); an empty denominator counts as 1."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    p, a = F.col("predicted") == 1, F.col("actual") == 1
    s = rows.rollup(group).agg(n(p & a).alias("tp"), n(p & ~a).alias("fp"), n(~p & a).alias("fn"))
    ratio = lambda x, y: F.when(x + y == 0, 1.0).otherwise(x / (x + y))
    return s.withColumn("recall", ratio(F.col("tp"), F.col("fn"))).withColumn("precision", ratio(F.col("tp"), F.col("fp")))


def match_spans(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds outcome to found spans (file, s, e): hit if equal to or inside a gated label, neutral inside another, else false."""
    inside = (F.col("l.file") == F.col("f.file")) & (F.col("l.s") <= F.col("f.s")) & (F.col("f.e") <= F.col("l.e"))
    joined = found.alias("f").join(labels.alias("l"), inside, "left").groupBy("f.file", "f.s", "f.e").agg(F.max(F.col("l.gated")).alias("gated"))
    return joined.withColumn("outcome", F.when(F.col("gated"), "hit").when(F.col("gated").isNotNull(), "neutral").otherwise("false"))


def corpus_report(found: DataFrame, labels: DataFrame) -> DataFrame:
    """type (null: all), tp, fp, fn, recall, precision of found spans (file, s, e, type) against labels (file, s, e, type, gated).

    A gated label is found if some span lies on or in it; a span outside every label is a false alarm of its own type, one inside a label that
    isn't gated counts for nothing.
    """
    spans = found.select("file", "s", "e", "type").distinct()
    judged = match_spans(spans, labels).join(spans, ["file", "s", "e"])
    alarms = judged.where("outcome = 'false'").select("type", F.lit(0).alias("actual"), F.lit(1).alias("predicted"))
    wanted = labels.where("gated").select("file", "s", "e", "type").distinct()
    inside = (F.col("f.file") == F.col("l.file")) & (F.col("l.s") <= F.col("f.s")) & (F.col("f.e") <= F.col("l.e"))
    hit = wanted.alias("l").join(spans.select("file", "s", "e").distinct().alias("f"), inside, "left").groupBy("l.file", "l.s", "l.e", "l.type").agg(F.max(F.col("f.s").isNotNull().cast("int")).alias("predicted"))
    return report(hit.select("type", F.lit(1).alias("actual"), "predicted").unionByName(alarms), "type")
