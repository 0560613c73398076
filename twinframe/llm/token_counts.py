"""Token counts by separator scan: document lengths from flat files of ids that have no index.

A file is a run of unsigned little-endian ids (16-bit where the vocabulary fits, else 32-bit) with an end-of-document id after each
document. Each file is read in blocks,
by any task; a block's separators come from one vectorised comparison. A document may span blocks: a prefix scan over the
blocks' summaries (number of separators, place of the last) gives each block its first document's start and ordinal.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinframe.llm import tokens
from twinframe.llm.common import documents, filesystem, new_path, partitions, prepare, text_of, written

BLOCK_TOKENS = 1 << 20


def write_flat(docs: DataFrame, tokenizer: str, folder: str, end_id: int, width: int) -> DataFrame:
    """Writes flat files; returns path, ordinal, doc_id: which document is a file's how-manieth. Nothing about places is kept."""

    def write(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        enc, kind = tokens.encoder(tokenizer), f"<u{width}"
        end = np.array([end_id], kind).tobytes()
        path, n = f"{folder}/{uuid.uuid4().hex}.ids", 0
        with fs.open_output_stream(filesystem(path)[1]) as out:
            for batch in batches:
                for ids in enc.encode(batch.column("text").cast(pa.binary()).to_pylist()):
                    out.write(np.frombuffer(ids, "<u4").astype(kind).tobytes())
                    out.write(end)
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([path] * k, pa.string()), pa.array(range(n, n + k), pa.int64()), batch.column("doc_id")], names=["path", "ordinal", "doc_id"])
                n += k

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(write, "path string, ordinal long, doc_id long"), "order")


def scan(paths: DataFrame, end_id: int, width: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """path, ordinal, start, n_tokens (without the separator), ended: each document of the files named in ``path``.

    Ids after a file's last separator are one more document with ended = false; an empty file has none.
    """

    def sizes(batches):
        for batch in batches:
            names = batch.column("path").to_pylist()
            fs = [filesystem(p) for p in names]
            n = [f.get_file_info(p).size // width for f, p in fs]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64())], names=["path", "n"])

    def search(batches):
        for batch in batches:
            for path, block, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    f.seek(width * first)
                    at = np.flatnonzero(np.frombuffer(f.read(width * n), f"<u{width}") == end_id) + first
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int64()), pa.array([first + n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(at.astype("i8")))], names=["path", "block", "stop", "ends"])

    files = paths.select("path").distinct().mapInArrow(sizes, "path string, n long")
    step = F.lit(block_tokens)
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step.cast("long"))).otherwise(F.array().cast("array<long>"))
    blocks = files.select("path", "n", F.explode(starts).alias("first")).select("path", (F.col("first") / block_tokens).cast("long").alias("block"), "first", F.least(step, F.col("n") - F.col("first")).cast("long").alias("size"))
    summary = written(blocks.repartition("path", "block").mapInArrow(search, "path string, block long, stop long, ends array<long>"), "separators")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("block").over(Window.partitionBy("path"))
    # The prefix scan takes two numbers a block, not its separators.
    scanned = summary.select("path", "block", F.size("ends").alias("n"), F.array_max("ends").alias("last")).select(
        "path",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"),
        F.coalesce(F.max("last").over(before) + 1, F.lit(0)).cast("long").alias("open"),
        (F.col("block") == last).alias("final"),
    )
    stitched = summary.join(scanned, ["path", "block"])
    froms = F.concat(F.array("open"), F.transform("ends", lambda e: e + 1))
    tos = F.concat(F.col("ends"), F.when(F.col("final") & (F.element_at(froms, -1) < F.col("stop")), F.array("stop")).otherwise(F.array().cast("array<long>")))
    rows = stitched.select("path", "base", "ends", F.posexplode(F.arrays_zip(froms.alias("a"), tos.alias("b"))).alias("k", "x"))
    return rows.where(F.col("x.b").isNotNull()).select(
        "path",
        (F.col("base") + F.col("k")).alias("ordinal"),
        F.col("x.a").alias("start"),
        (F.col("x.b") - F.col("x.a")).alias("n_tokens"),
        (F.col("k") < F.size("ends")).alias("ended"),
    )


def separator(tokenizer: str) -> tuple[int, int]:
    """The end-of-document id, which no text can spell as it is outside the vocabulary, and the bytes of an id: the largest number of those bytes."""
    top = max(tokens.encoder(tokenizer).library.get_vocab().values(), default=0)
    width = 2 if top < (1 << 16) - 1 else 4
    return (1 << 8 * width) - 1, width


def token_counts(docs: DataFrame, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens: writes docs' ids to flat files in the shared folder and counts them by scanning those.

    Null and empty texts have 0 tokens. Repeated rows and null doc_ids are counted each for itself. Every id of a text counts, those of special
    tokens that it spells out too. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    tokenizer = tokenizer or tokens.default_path()
    end_id, width = separator(tokenizer)
    order = write_flat(docs, tokenizer, new_path(spark, "flat"), end_id, width)
    counted = scan(order, end_id, width, block_tokens)
    return order.join(counted.hint("merge"), ["path", "ordinal"], "left").select("doc_id", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"))


def op5_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir))
