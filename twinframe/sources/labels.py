"""Labelled corpora: labels.json files as one table of labelled spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions import text as fn

PLACE = "file string, byte_start int, byte_end int, line int"
SCHEMA = f"""project string, description string, entity_count int, occurrence_count int,
entities array<struct<real_name string, entity_type string, scope_path string, note string, occurrences array<struct<{PLACE}>>>>,
secrets array<struct<{PLACE}, secret_type string, confidence string>>,
requires array<string>, milestone string, negative_files array<string>, never_alias array<string>, ignored_paths array<string>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """The projects of labels.json files below a folder, one row each."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "labels.json").json(path)


def occurrences(projects: DataFrame) -> DataFrame:
    """project, file, s, e, type, real_name, gated: labelled names; structure is labelled but not gated, as it stays readable."""
    each = projects.select("project", F.explode("entities").alias("n")).select("project", "n.real_name", F.col("n.entity_type").alias("type"), F.explode("n.occurrences").alias("o"))
    return each.select("project", F.col("o.file").alias("file"), F.col("o.byte_start").alias("s"), F.col("o.byte_end").alias("e"), "type", "real_name", fn.is_identity(F.col("type")).alias("gated"))


def secrets(projects: DataFrame) -> DataFrame:
    """project, file, s, e, secret_type, confidence: labelled credentials."""
    each = projects.select("project", F.explode("secrets").alias("x"))
    return each.select("project", F.col("x.file").alias("file"), F.col("x.byte_start").alias("s"), F.col("x.byte_end").alias("e"), "x.secret_type", "x.confidence")
