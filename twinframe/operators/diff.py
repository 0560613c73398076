"""Line diffs of text versions as nested hunks, and patches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.operators import restore

HUNKS = "array<struct<kind:string,a_start:int,a_end:int,b_start:int,b_end:int>>"


def _hunks(before: pd.Series, after: pd.Series) -> pd.Series:
    """Runs of changed lines: Added, Removed, Changed, or Formatting where only white space differs."""

    def one(a, b):
        a, b = (a or "").splitlines(), (b or "").splitlines()
        out = []
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag != "equal":
                same = "".join("".join(a[i:j]).split()) == "".join("".join(b[k:m]).split())
                kind = "Formatting" if same else {"insert": "Added", "delete": "Removed"}.get(tag, "Changed")
                out.append({"kind": kind, "a_start": i, "a_end": j, "b_start": k, "b_end": m})
        return out

    return pd.Series([one(a, b) for a, b in zip(before, after)])


def _patch(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    """A unified diff with three lines of context."""

    def one(p, a, b):
        return "".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), f"a/{p}", f"b/{p}"))

    return pd.Series([one(*x) for x in zip(path, before, after)])


def hunks(before: Column | str, after: Column | str) -> Column:
    return F.pandas_udf(_hunks, HUNKS).asNondeterministic()(before, after)


def patch(path: Column | str, before: Column | str, after: Column | str) -> Column:
    return F.pandas_udf(_patch, "string")(path, before, after)


def _attached(hunks_: pd.Series, notes: pd.Series) -> pd.Series:
    def one(found, of):
        rows = [] if found is None else [dict(h) for h in found]
        for h in rows:  # notes count lines from 1; a removal takes those of the line that follows it
            last = max(h["b_end"], h["b_start"] + 1)
            h["notes"] = [n for n in ([] if of is None else of) if h["b_start"] < n["line"] <= last]
        return rows

    return pd.Series([one(*x) for x in zip(hunks_, notes)])


def with_notes(hunks_: Column | str, notes: Column | str) -> Column:
    """Hunks, each with the restorer's notes on its lines of the later text."""
    return F.pandas_udf(_attached, HUNKS.replace("b_end:int", f"b_end:int,notes:{restore.NOTES}")).asNondeterministic()(hunks_, notes)


def review(docs: DataFrame, identities: list[tuple[str, str]]) -> DataFrame:
    """Adds to docs (original, twin, reply) what came back: restored, unresolved, notes, changes (original to restored, with notes),
    edits (twin to reply) and may_patch, false while an alias is unresolved."""
    d = restore.restore_text(docs.withColumn("text", F.col("reply")), identities).withColumn("_h", hunks("original", "restored"))
    return d.select(
        *docs.columns, "restored", "unresolved", "notes", with_notes("_h", "notes").alias("changes"), hunks("twin", "reply").alias("edits"), (F.size("unresolved") == 0).alias("may_patch")
    )


def may_patch(unresolved: Column, checksum: Column, recorded: Column) -> Column:
    """A patch needs every alias resolved and the file as it was recorded."""
    return (F.size(unresolved) == 0) & (checksum == recorded)
