"""The identity dimension: keys, alias allocation, concepts, renumbering."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe import vocab
from twinframe.functions import text as fn
from twinframe.sources import rows


def scope_of(entity_type: Column, scope: Column) -> Column:
    """Identities are one wherever they occur; structure keeps its scope."""
    return F.when(fn.is_identity(entity_type), "identity").otherwise(scope)


def key_of(scope: Column, entity_type: Column, name: Column) -> Column:
    """A reproducible identifier of an identity."""
    return F.sha2(F.concat_ws("\x1f", scope_of(entity_type, scope), entity_type, name), 256)


def first_seen(occurrences: DataFrame, *order: str) -> DataFrame:
    """One row per (scope_path, entity_type, real_name) with its earliest place; pre-aggregated in each task."""
    keys = occurrences.withColumn("scope_path", scope_of(F.col("entity_type"), F.col("scope_path")))
    return keys.groupBy("scope_path", "entity_type", "real_name").agg(F.min(F.struct(*order)).alias("place"))


def allocate(names: DataFrame, order: Column, existing: DataFrame | None = None) -> DataFrame:
    """Adds number and alias to names (entity_type, real_name, ...): numbers go on from the largest issued, in the given total order.

    Runs over distinct identities, never over occurrences; a type's ranks come from a sort by range and a prefix scan, not from one task.
    """
    if existing is None:
        numbered = rows.ranked(names, "entity_type", order, "number")
    else:
        new = names.join(existing.select("scope_path", "entity_type", "real_name"), ["scope_path", "entity_type", "real_name"], "left_anti")
        issued = existing.groupBy("entity_type").agg(F.max("number").alias("issued"))
        numbered = rows.ranked(new, "entity_type", order, "n").join(F.broadcast(issued), "entity_type", "left")  # at most one row per type
        numbered = numbered.withColumn("number", (F.col("n") + F.coalesce("issued", F.lit(0))).cast("bigint")).drop("n", "issued")
    return numbered.withColumn("alias", fn.format_alias(F.col("entity_type"), F.col("number")))


def rekey(identities: DataFrame) -> DataFrame:
    """Renumbers each type from 1 by uuid; adds new_alias and changed."""
    again = allocate(identities.drop("alias", "number"), F.col("uuid")).select("uuid", F.col("alias").alias("new_alias"))
    return identities.join(again, "uuid").withColumn("changed", F.col("alias") != F.col("new_alias"))


def propose(keys: DataFrame) -> DataFrame:
    """norm, kinds, members, confidence: names that several kinds of artifact share and that may be one concept.

    Each kind needs a compatible partner among the others; a kind that occurs twice halves the confidence.
    """
    named = keys.where(F.col("entity_type").isin(*vocab.UNIFIABLE)).select("entity_type", "real_name", "scope_path", fn.fold_name(F.col("real_name")).alias("norm")).distinct()
    groups = named.groupBy("norm").agg(F.array_sort(F.collect_set("entity_type")).alias("kinds"), F.count("*").alias("members"))
    pairs = F.array(*(F.lit(f"{x}+{y}") for a, b in vocab.COMPATIBLE for x, y in ((a, b), (b, a))))
    partnered = F.forall("kinds", lambda k: F.exists("kinds", lambda j: F.array_contains(pairs, F.concat_ws("+", k, j))))
    kept = groups.where((F.col("members") >= 2) & (F.size("kinds") >= 2) & partnered)
    return kept.withColumn("confidence", F.when(F.col("members") > F.size("kinds"), 0.5).otherwise(1.0))


def confirm_concepts(identities: DataFrame, concepts: DataFrame) -> DataFrame:
    """Members of a confirmed concept take the number of its first one, where that is free in their type."""
    # Members alone meet by concept; all the others, most of an identity table, stay where they are.
    shared = identities.join(concepts, "uuid")
    others = identities.join(concepts, "uuid", "left_anti")
    lead = F.first("number").over(Window.partitionBy("concept").orderBy("number", "uuid"))
    wanted = shared.withColumn("wanted", F.when(F.col("concept").isNotNull(), lead))
    taken = identities.select(F.col("entity_type").alias("_t"), F.col("number").alias("_n")).distinct()
    free = wanted.join(taken, (F.col("entity_type") == F.col("_t")) & (F.col("wanted") == F.col("_n")) & (F.col("wanted") != F.col("number")), "left")
    rank = F.row_number().over(Window.partitionBy("entity_type", "wanted").orderBy("number", "uuid"))
    number = F.when(F.col("wanted").isNotNull() & F.col("_n").isNull() & (rank == 1), F.col("wanted")).otherwise(F.col("number"))
    again = free.withColumn("number", number).withColumn("alias", fn.format_alias(F.col("entity_type"), F.col("number"))).drop("wanted", "_t", "_n")
    return again.unionByName(others.withColumn("concept", F.lit(None).cast("string")))


def resolve(existing: DataFrame, alias: str, name: str, entity_type: str, scope: str = "file") -> DataFrame:
    """The identities and one that a model invented, under the alias that it gave it, which must be well formed and not issued."""
    match = re.match(fn.ALIAS, alias)
    if not match:
        raise ValueError(f"{alias} has not the shape of an alias")
    if not existing.where(F.col("alias") == alias).isEmpty():
        raise ValueError(f"{alias} is issued already")
    cells = {"entity_type": entity_type, "real_name": name, "alias": alias}
    row = existing.sparkSession.range(1).select(*(F.lit(v).alias(k) for k, v in cells.items()), F.lit(int(match[2])).cast("bigint").alias("number"))
    row = row.withColumn("scope_path", scope_of(F.col("entity_type"), F.lit(scope))).withColumn("uuid", key_of(F.lit(scope), F.col("entity_type"), F.col("real_name")))
    return existing.unionByName(row.select(*(c for c in row.columns if c in existing.columns)), allowMissingColumns=True)


def context(identities: DataFrame) -> DataFrame:
    """kind (member, name, folded), name: what a project knows, for readers of one file: its field names, all names, and their folded forms."""
    kinds = F.array(
        F.struct(F.when(F.col("entity_type") == "column", "member").alias("kind"), F.col("real_name").alias("name")),
        F.struct(F.lit("name").alias("kind"), F.col("real_name").alias("name")),
        F.struct(F.lit("folded").alias("kind"), fn.fold_name(F.col("real_name")).alias("name")),
    )
    return identities.select(F.explode(kinds).alias("x")).select("x.kind", "x.name").where("kind IS NOT NULL").distinct()


def type_counts(typed: DataFrame, column: str = "entity_type") -> DataFrame:
    return typed.groupBy(column).agg(F.count("*").alias("n"))
