"""File trees as tables, and tables as file trees."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions import text as fn
from twinframe.sources import ignore as ignore_

MAX_BYTES = 5 * 1024 * 1024
SNIFF = 8192


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """path, size, modified, is_text, checksum, parser, content (null if binary) of files up to 5 MiB, outside ignored paths.

    Ignore patterns are those of the ignore files of every directory, and those given (see sources.ignore). The size filter reaches the file
    source.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MAX_BYTES)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", ""), "^" + base + "/", "")
    d = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    d = d.where(~F.rlike("path", F.lit(r"(^|/)\.(git|twinframe)/")))
    d = d.join(ignore_.ignored(d.select("path"), ignore_.read(root, d.select("path"), ignore)), "path", "left_anti")
    binary = F.locate("00", F.hex(F.substring("content", 1, SNIFF)))
    nul = F.exists(F.sequence(F.lit(0), F.least(F.length("content"), F.lit(SNIFF)) - 1), lambda i: F.substring("content", i + 1, F.lit(1)) == F.unhex(F.lit("00")))
    d = d.withColumn("is_text", ~((F.length("content") > 0) & (binary > 0) & nul))
    text = F.when(F.col("is_text"), F.decode("content", "UTF-8"))
    return d.select("path", "size", "modified", "is_text", F.sha2("content", 256).alias("checksum"), text.alias("content"), F.col("content").alias("bytes")).withColumn("parser", F.when(F.col("is_text"), fn.format_of(F.col("path"), F.col("content"))))


def write_tree(df: DataFrame, root: str, path_column: str, content_column: str) -> tuple[int, int]:
    """Writes each row's content to root/path from the executors; returns how many files and bytes. Refuses an existing root.

    All or nothing: files are staged beside the root, which gets its name when all are there. A retried task writes the same files again.
    """
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(root)
    if fs.get_file_info(base).type != pafs.FileType.NotFound:
        raise FileExistsError(root)
    stage = f"{base}.{uuid.uuid4().hex}"

    def write(batches):
        import pandas as pd

        fs, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            sizes = []
            for path, content in zip(batch["path"], batch["content"]):
                if ".." in path.split("/"):
                    raise ValueError(f"{path} leaves the tree")
                data = content if isinstance(content, bytes) else (content or "").encode()
                fs.create_dir(f"{stage}/{path}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{stage}/{path}") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"bytes": sizes})

    fs.create_dir(stage, recursive=True)
    try:
        done = df.select(F.col(path_column).alias("path"), F.col(content_column).alias("content")).mapInPandas(write, "bytes long")
        files, total = done.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        fs.move(stage, base)
    except BaseException:
        fs.delete_dir(stage)
        raise
    return files, total


def restore_paths(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Twin paths back to original ones; files that the catalog doesn't know stay where they are."""
    known = catalog.select("twin_path", F.col("path").alias("_path"))
    return files.join(known, files["path"] == known["twin_path"], "left").withColumn("path", F.coalesce("_path", "path")).drop("_path", "twin_path")


def audit_csv(log: DataFrame, path: str) -> None:
    """RFC 4180: quotes only where needed, doubled inside."""
    log.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)
