"""From aliases back to names: exact, by canonical form, without appended affixes, or inside longer tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe import vocab
from twinframe.functions import text as fn


def vocabulary(identities: DataFrame) -> DataFrame:
    """alias, real_name, canonical, ambiguous: a canonical form that several names share is no fuzzy match."""
    named = identities.select("alias", "real_name", fn.canonical(F.col("alias")).alias("canonical"))
    counts = named.groupBy("canonical").agg((F.count_distinct("real_name") > 1).alias("ambiguous"))
    return named.join(counts, "canonical")


def resolve(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Adds real_name and match_kind (exact, canonical, affix; null if none) and unresolved to rows with a token."""
    affix = "(" + "|".join(sorted(vocab.AFFIXES, key=lambda a: (-len(a), a))) + ")$"
    fuzzy = words.where("NOT ambiguous").groupBy("canonical").agg(F.min("real_name").alias("fuzzy_name"))
    stem = F.when(F.rlike("token", F.lit(affix)), F.regexp_replace("token", affix, ""))
    # Tokens repeat: the distinct ones are looked up, and what they are goes back to all.
    d = tokens.select("token").distinct().withColumn("_canonical", fn.canonical(F.col("token"))).withColumn("_stem", fn.canonical(stem))
    d = d.join(words.select(F.col("alias").alias("token"), F.col("real_name").alias("_exact")), "token", "left")
    d = d.join(fuzzy.select(F.col("canonical").alias("_canonical"), F.col("fuzzy_name").alias("_fuzzy")), "_canonical", "left")
    d = d.join(fuzzy.select(F.col("canonical").alias("_stem"), F.col("fuzzy_name").alias("_by_stem")), "_stem", "left")
    kind = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_fuzzy").isNotNull(), "canonical").when(F.col("_by_stem").isNotNull(), "affix")
    d = d.withColumn("real_name", F.coalesce("_exact", "_fuzzy", "_by_stem")).withColumn("match_kind", kind)
    known = d.select("token", "real_name", "match_kind", (F.col("real_name").isNull() & fn.is_alias(F.col("token"))).alias("unresolved"))
    return tokens.join(known, "token", "left")


def tokens_of(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.select(id_column, F.explode(F.filter(F.split("text", "[^A-Za-z0-9_]+"), lambda t: t != "")).alias("token"))


NOTES = "array<struct<line:int,kind:string,token:string,real_name:string>>"


def restore_text(docs: DataFrame, identities: list[tuple[str, str]]) -> DataFrame:
    """Adds restored, unresolved (array) and notes to docs. ``identities`` is (alias, real_name), bounded by the caller and broadcast.

    Notes name, by line of the restored text, what a reader should look at: names that no exact alias gave (fuzzy), aliases of no
    identity (unresolved) and markers of redacted secrets (redaction).
    """
    shared = docs.sparkSession.sparkContext.broadcast(identities)

    def canon(token: str) -> str:
        out = re.sub(r"([0-9])S$", r"\1", re.sub("[^A-Za-z0-9]", "", token).upper())
        return re.sub(r"(?<![0-9])0+(?=[0-9])", "", out)

    @F.pandas_udf(f"restored string, unresolved array<string>, notes {NOTES}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        exact = dict(shared.value)
        fuzzy: dict[str, str | None] = {}
        for alias, name in shared.value:
            c = canon(alias)
            fuzzy[c] = name if fuzzy.get(c, name) == name else None
        inside = re.compile(f"(?:{fn._PREFIXES})_[0-9]+")  # aliases have one shape, whatever their number
        shape = re.compile(fn.ALIAS)
        affixes = sorted(vocab.AFFIXES, key=len, reverse=True)

        def word(token: str) -> tuple[str, str | None]:
            if token in exact:
                return exact[token], None
            stem = next((token[: -len(a)] for a in affixes if token.endswith(a)), "")
            name = fuzzy.get(canon(token)) or exact.get(stem) or (fuzzy.get(canon(stem)) if stem else None)
            if name:
                return name, "fuzzy"
            if shape.match(token):
                return token, "unresolved"
            return inside.sub(lambda x: exact.get(x[0], x[0]), token), None

        def one(text):
            if text is None:
                return None, [], []
            out, notes, line, at = [], [], 1, 0
            for m in re.finditer(r"<<REDACTED:[^>\n]*>>|[A-Za-z0-9_]+", text):
                new, kind = (m[0], "redaction") if m[0].startswith("<<") else word(m[0])
                out += [text[at : m.start()], new]
                line += text.count("\n", at, m.start())
                if kind:
                    notes.append({"line": line, "kind": kind, "token": m[0], "real_name": new if kind == "fuzzy" else None})
                line, at = line + new.count("\n"), m.end()
            return "".join(out) + text[at:], [x["token"] for x in notes if x["kind"] == "unresolved"], notes

        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["restored", "unresolved", "notes"])

    return docs.withColumn("_r", run("text")).select(*docs.columns, "_r.restored", "_r.unresolved", "_r.notes")
