"""The leak gate: what of the known names survived, in any spelling, where, and whether an export may go out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.functions import text as fn
from twinframe.operators import detect, dictionary
from twinframe.sources import rows

#: Names that are sent to the executors as one automaton; more are joined to the texts by pieces (see operators.dictionary).
MAX_NAMES = 300_000
LEAK = "array<struct<real_name:string,matched:string,byte_start:int,byte_end:int,line:int,col:int>>"


def watched(names: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """real_name: the distinct names that identify and aren't allowed, in any case."""
    kept = names.where(fn.is_identifying(F.col("real_name"))).select("real_name").distinct()
    return kept.where(~F.lower("real_name").isin(sorted({a.lower() for a in allow or ()})))


def _places(machine, text: str | None) -> list[dict]:
    out, line, at, begun, passed = [], 1, 0, 0, 0  # passed: bytes before ``at``; begun: bytes before the line
    if not text or machine is None:
        return out
    for end, (n, name) in machine.iter_long(detect.ascii_lower(text)):
        s, e = end + 1 - n, end + 1
        if s and text[s - 1].isalnum() or text[e : e + 1].isalnum():
            continue
        gap = text[at:s]
        if (last := gap.rfind("\n")) >= 0:
            line += gap.count("\n")
            begun = passed + len(gap[: last + 1].encode())
        passed += len(gap.encode())
        size = len(text[s:e].encode())
        out.append({"real_name": name, "matched": text[s:e], "byte_start": passed, "byte_end": passed + size, "line": line, "col": passed - begun + 1})
        at = s
    return out


def places(docs: DataFrame, names: DataFrame, allow: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds leaks to docs: array of struct<real_name, matched, byte_start, byte_end, line, col> by place; line and col count from 1, col in bytes.

    Leftmost longest variants that are whole tokens, where an underscore ends a token; a variant that isn't whole consumes its text. The first
    name owns a spelling that several have. Up to MAX_NAMES names are one automaton, and the scan is map-only; with more, each text has an
    automaton of the names whose pieces it holds, with the same leaks.
    """
    rows.small_batches(docs.sparkSession)
    kept = watched(names, allow)
    few = kept.limit(MAX_NAMES + 1).collect()
    if len(few) > MAX_NAMES:
        return _joined_places(docs, kept, text)
    variants: dict[str, str] = {}
    for name in sorted(r.real_name for r in few):
        for v in detect.spellings(name):
            variants.setdefault(v.translate(detect.ASCII_LOWER), name)
    shared = docs.sparkSession.sparkContext.broadcast(variants)

    @F.pandas_udf(LEAK)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = detect.machine(shared.value)
        for batch in batches:
            yield pd.Series([_places(machine, t) for t in batch])

    return docs.withColumn("leaks", find.asNondeterministic()(text))


def _joined_places(docs: DataFrame, names: DataFrame, text: str) -> DataFrame:
    patterns = detect.spelled(names).groupBy(F.col("variant").alias("pattern")).agg(F.min("real_name").alias("real_name"))
    row = rows.fresh("_row", docs)
    numbered = rows.numbered(docs, row, rows.cut)
    met = dictionary.candidates(numbered.select(F.col(row).alias("row"), F.col(text).alias("text")), rows.cut(dictionary.filed(patterns)), detect.ascii_lower)
    met = met.groupBy(F.col("row").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct("pattern", "real_name"))).alias("_met"))

    @F.pandas_udf(LEAK)
    def find(texts: pd.Series, met: pd.Series) -> pd.Series:
        return pd.Series([_places(detect.machine(dict(m or {})), t) for t, m in zip(texts, met)])

    d = numbered.join(met, row, "left").withColumn("leaks", find.asNondeterministic()(F.col(text), F.col("_met")))
    return d.select(*docs.columns, "leaks")


def leaks(docs: DataFrame, names: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """doc_id, real_name, n: how often each document holds a name in any spelling."""
    found = places(docs.select("doc_id", "text"), names, allow).select("doc_id", F.explode("leaks").alias("x"))
    return found.groupBy("doc_id", F.col("x.real_name").alias("real_name")).agg(F.count("*").alias("n"))


def top_leaks(found: DataFrame, n: int) -> DataFrame:
    return found.groupBy("real_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "real_name").limit(n)


def export_policy(secrets: DataFrame, found: DataFrame, strict: bool) -> DataFrame:
    """One row: refused if a high-confidence secret is left, or, when strict, if there is a leak."""
    a = secrets.agg(F.coalesce(F.sum(F.when(F.col("confidence") == "high", 1).otherwise(0)), F.lit(0)).cast("bigint").alias("high_secrets"))
    b = found.agg(F.count("*").alias("leaks"))
    return a.join(b, F.lit(True)).withColumn("refused", (F.col("high_secrets") > 0) | (F.lit(strict) & (F.col("leaks") > 0)))
