"""Incremental work over an inbox: a stream of documents is redacted and detected without state; identities are appended in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.operators import redaction
from twinframe.plans import sanitize

SCHEMA = "doc_id long, path string, text string"


def redactions(stream: DataFrame) -> DataFrame:
    """doc_id, text, blocks: the redacted text of each document and whether it held a high-confidence secret. Stateless."""
    d = sanitize.redacted(stream)
    return d.select("doc_id", "text", redaction.blocks_export(F.col("findings")).alias("blocks"))


def start(spark: SparkSession, inbox: str, checkpoint: str, sink: Callable[[DataFrame, int], None], terms: dict[str, str] | None = None):
    """Runs each micro-batch of new Parquet files through candidates and hands (docs, batch number) to the sink, the catalog's one writer.

    A batch may come again after a failure; sinks key their writes by its number.
    """
    stream = spark.readStream.schema(SCHEMA).parquet(inbox)

    def batch(df: DataFrame, number: int) -> None:
        sink(sanitize.candidates(sanitize.redacted(df), terms), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_identities(existing: DataFrame, found: DataFrame) -> DataFrame:
    """The catalog's identities and the new ones of a batch, numbered on from the largest issued."""
    return existing.unionByName(sanitize.identities(found, None, existing))


