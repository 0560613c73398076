"""Structure of source artifacts: fingerprints that a rewrite must keep, declared names with their places, and prose regions.

Fingerprints are maps name -> count. Markdown's are built-in expressions; the formats that need a parser with state are pandas UDFs over
sources.parsers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinframe.sources import parsers

NAMES = "array<struct<scope:string,type:string,name:string,s:int,e:int>>"
REGIONS = "array<struct<s:int,e:int>>"
COUNTS = "map<string,bigint>"
NODES = "array<struct<path:string,what:string,text:string,s:int,e:int>>"


def markdown_fingerprint(text: Column) -> Column:
    """headings (with a title, outside fenced code), fences, lines and h1..h6."""
    parts = F.split(text, r"(?md)^\s*(?:```|~~~)[^\n]*")  # every other part lies between two fences
    outside = F.array_join(F.filter(parts, lambda x, i: i % 2 == 0), "\n")
    heads = F.transform(F.regexp_extract_all(outside, F.lit(r"(?md)^(#{1,6})[ \t]+\S"), F.lit(1)), F.length)
    pairs = [("headings", F.size(heads)), ("fences", F.size(parts) - 1), ("lines", F.size(F.split(text, "\n")))]
    count = lambda level: F.size(F.filter(heads, lambda n: n == level))
    pairs += [(f"h{k}", count(k)) for k in range(1, 7)]
    return F.create_map(*(x for k, v in pairs for x in (F.lit(k), v.cast("bigint"))))


def section_at(outline: Column, offset: Column) -> Column:
    """The last heading (array<struct<s, title>>) at or before an offset."""
    return F.try_element_at(F.filter(outline, lambda h: h["s"] <= offset), F.lit(-1))["title"]


_NAMES = {"sql": parsers.sql_names, "plantuml": parsers.plantuml_names, "typescript": parsers.typescript_names, "openapi": parsers.openapi_names}
_REGIONS = {"plantuml": parsers.plantuml_regions, "typescript": parsers.typescript_regions}
_COUNTS = {
    "sql": parsers.sql_counts, "plantuml": parsers.plantuml_counts, "typescript": parsers.typescript_counts,
    "openapi": parsers.openapi_counts, "yaml": parsers.yaml_counts, "json": parsers.yaml_counts,
}


class _Bytes:
    """Byte offsets of character offsets, asked for in ascending order or not."""

    def __init__(self, text: str):
        self.text, self.plain = text, text.isascii()

    def __call__(self, at: int) -> int:
        return at if self.plain else len(self.text[:at].encode())


def _declared(parser: pd.Series, content: pd.Series) -> pd.Series:
    """Declared names by format; markdown, text, yaml and json declare none. What doesn't parse declares nothing."""

    def one(p, c):
        at = _Bytes(c or "")
        return [{"scope": scope, "type": kind, "name": name, "s": at(s), "e": at(e)} for scope, kind, name, s, e in _NAMES.get(p, lambda _: [])(c or "")]

    return pd.Series([one(p, c) for p, c in zip(parser, content)])


def _regions(parser: pd.Series, content: pd.Series) -> pd.Series:
    def one(p, c):
        found, at = _REGIONS[p](c or "") if p in _REGIONS else None, _Bytes(c or "")
        return None if found is None else [{"s": at(s), "e": at(e)} for s, e in found]

    return pd.Series([one(p, c) for p, c in zip(parser, content)])


def _node_lists(content: pd.Series) -> pd.Series:
    """The node index of YAML and JSON with dotted paths and byte offsets; null if it doesn't parse."""

    def one(c):
        found, at = parsers.nodes(c or ""), _Bytes(c or "")
        return None if found is None else [{"path": p, "what": w, "text": t, "s": at(s), "e": at(e)} for p, w, t, s, e in found]

    return pd.Series([one(c) for c in content])


def _code_counts(parser: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([_COUNTS[p](c or "") if p in _COUNTS else None for p, c in zip(parser, content)])


# The functions below make their UDFs when called, so that importing needs no session; non-deterministic ones aren't inlined into the
# expressions that read them, and each row is parsed once.
def declared(parser: Column | str, content: Column | str) -> Column:
    return F.pandas_udf(_declared, NAMES).asNondeterministic()(parser, content)


def nodes(content: Column | str) -> Column:
    return F.pandas_udf(_node_lists, NODES).asNondeterministic()(content)


def regions(parser: Column | str, content: Column | str) -> Column:
    """Where prose may stand: comments and strings of code, a diagram's lines but for the renderer's; null where all of a text is prose."""
    return F.pandas_udf(_regions, REGIONS).asNondeterministic()(parser, content)


def code_fingerprint(parser: Column | str, content: Column | str) -> Column:
    return F.pandas_udf(_code_counts, COUNTS)(parser, content)


def fingerprint(parser: Column, content: Column) -> Column:
    """The counts of a format; null for plain text and for what doesn't parse."""
    coded = F.when(parser.isin(*_COUNTS), code_fingerprint(parser, content))
    return F.when(parser == "markdown", markdown_fingerprint(content)).otherwise(coded)


def differences(before: Column, after: Column) -> Column:
    """The counts that a rewrite changed."""
    return F.map_filter(F.map_zip_with(before, after, lambda k, a, b: ~a.eqNullSafe(b)), lambda k, v: v)
