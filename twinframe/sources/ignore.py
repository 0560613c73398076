"""Ignore rules of a hierarchy, as tables: each rule belongs to a directory, and the last one that matches a path decides.

A rule is tried on every file and directory below its own directory. Rules of deeper directories come after those of higher ones, later
lines after earlier ones; all of the engine's own ignore files come after all of git's, and rules that a caller gives come last. What
is below an ignored directory is ignored, whatever other rules say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files of patterns, the later kind before the earlier one.
FILES = (".gitignore", ".twinframeignore")
RULES = "kind int, dir string, line int, keeps boolean, dirs_only boolean, regex string"
#: Up to so many rules are broadcast.
BROADCAST_RULES = 100_000


def rule(line: str) -> tuple[bool, bool, str] | None:
    """Whether a line of an ignore file takes back, whether it is about directories alone, and its pattern over paths below its directory."""
    line = re.sub(r"(?<!\\)[ \t\r]+$", "", line)
    if not line or line.startswith("#"):
        return None
    keeps = line.startswith("!")
    line = line[1:] if keeps else line
    dirs_only = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    if not line:
        return None
    out, k = "" if anchored else "(?:.*/)?", 0
    while k < len(line):
        rest = line[k:]
        if m := re.match(r"\*\*/", rest) if k == 0 or line[k - 1] == "/" else None:
            out += "(?:.*/)?"
        elif m := re.match(r"\*\*$", rest) if k and line[k - 1] == "/" else None:
            out += ".+"
        elif m := re.match(r"\*+", rest):
            out += "[^/]*"
        elif m := re.match(r"\?", rest):
            out += "[^/]"
        elif m := re.match(r"\[(!|\^)?(\]?[^\]]*)\]", rest):
            cells = re.sub(r"([\\\[&^])", r"\\\1", m[2])
            out += f"(?!/)[{'^' if m[1] else ''}{cells}]"
        else:
            m = re.match(r"\\(.)|(.)", rest, re.S)
            out += re.sub(r"([^A-Za-z0-9])", r"\\\1", m[1] or m[2])
        k += m.end()
    return keeps, dirs_only, f"(?s)^{out}$"


def rules(lines: DataFrame) -> DataFrame:
    """The rules of lines (kind, dir, line, text); dir is relative to the root, which is empty."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, d, n, *r) for k, d, n, t in batch[["kind", "dir", "line", "text"]].itertuples(index=False) if t is not None and (r := rule(t))]
            yield pd.DataFrame(found, columns=["kind", "dir", "line", "keeps", "dirs_only", "regex"])

    return lines.mapInPandas(read, RULES)


def read(root: str, paths: DataFrame, given: list[str] | None = None) -> DataFrame:
    """The rules of the ignore files of every directory above one of the files (path, relative to the root), and given ones.

    Spark lists no file whose name begins with a dot, so each directory is asked for its ignore files, by the tasks.
    """
    whole = root if "://" in root else f"file://{root}"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(whole)
        for batch in batches:
            out = []
            for folder in batch["dir"]:
                asked = [f"{base.rstrip('/')}/{folder}/{name}".replace("//", "/") for name in FILES]
                for kind, info in enumerate(fs.get_file_info(asked)):
                    if info.type == pafs.FileType.File:
                        with fs.open_input_stream(info.path) as f:
                            out += [(kind, folder, n, t) for n, t in enumerate(f.read().decode(errors="replace").split("\n"))]
            yield pd.DataFrame(out, columns=["kind", "dir", "line", "text"])

    parts = F.split("path", "/")
    dirs = paths.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k > 0, F.array_join(F.slice(parts, F.lit(1), k), "/")).otherwise(""))).alias("dir")).distinct()
    schema = "kind int, dir string, line int, text string"
    own = paths.sparkSession.createDataFrame([(len(FILES), "", n, t) for n, t in enumerate(given or [])], schema)
    return rules(dirs.mapInPandas(ask, schema).unionByName(own))


def ignored(paths: DataFrame, rules_: DataFrame) -> DataFrame:
    """path of the files (path, relative to the root) that the rules leave out.

    Each directory is decided once, for all files below it.
    """
    parts = F.split("path", "/")
    upto = lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/")
    steps = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(upto(k).alias("step"), (k < F.size("parts")).alias("is_dir")))
    each = paths.select("path", parts.alias("parts")).select("path", F.explode(steps).alias("x")).select("path", "x.step", "x.is_dir")
    tried = each.select("step", "is_dir").distinct().withColumn("parts", F.split("step", "/"))
    dirs = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda k: F.struct(F.when(k > 0, upto(k)).otherwise("").alias("dir"), k.alias("depth")))
    tried = tried.withColumn("x", F.explode(dirs)).select("step", "is_dir", F.col("x.dir").alias("dir"), F.col("x.depth").alias("depth"))
    rules_ = rules_.select("kind", "dir", "line", "keeps", "dirs_only", "regex")
    few = rules_.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    below = F.when(F.col("dir") == "", F.col("step")).otherwise(F.expr("substring(step, length(dir) + 2)"))
    met = tried.join(F.broadcast(rules_) if few else rules_, "dir").where((F.col("is_dir") | ~F.col("dirs_only")) & F.rlike(below, F.col("regex")))
    last = met.groupBy("step", "is_dir").agg(F.max(F.struct("kind", "depth", "line", "keeps")).alias("x")).where("NOT x.keeps")
    return each.join(last.select("step", "is_dir"), ["step", "is_dir"], "left_semi").select("path").distinct()
