"""Spans over immutable text: byte offsets of matches, greedy selection, edits. Arrays of structs, folded on the JVM."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,t:string>>"


def find(text: Column, pattern: str, in_bytes: bool = True, needle: str = "", dense: bool = False) -> Column:
    """array<struct<s, e, t>>: leftmost non-overlapping matches, start and end (exclusive) in bytes or code points.

    ``needle`` is a string that every match holds: texts without it are passed over without the pattern. ``dense`` is for patterns that match
    all over a text: places are summed up by workers, in time that grows with the matches; on the JVM it grows with their square.
    """
    return _found(text, pattern, in_bytes, needle, False, dense)


def find_after(text: Column, pattern: str) -> Column:
    """array<struct<s, e, t, gap>> as of ``find``, in bytes; gap is the text between a match and the one before it."""
    return _found(text, pattern, True, "", True)


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it, in its lambdas too. Not for the arguments of a Python function."""
    return F.transform(F.array(value), f)[0]


def _starts(gaps: pa.Array, hits: pa.Array) -> pa.Array:
    """For workers: where each row's hits start, of the sizes of its gaps (one more than hits) and hits. Null lists count as empty."""
    n = pc.fill_null(pc.list_value_length(hits), 0).to_numpy(zero_copy_only=False).astype("i8")
    ends = np.cumsum(n)
    sizes = pc.fill_null(pc.list_value_length(gaps), 0).to_numpy(zero_copy_only=False).astype("i8")
    before = np.repeat(np.cumsum(sizes) - sizes, n)
    k = np.arange(len(before)) - np.repeat(ends - n, n)
    gap = gaps.flatten().to_numpy(zero_copy_only=False).astype("i8")[before + k]
    hit = hits.flatten().to_numpy(zero_copy_only=False).astype("i8")
    total = np.concatenate([[0], np.cumsum(gap + hit)])
    starts = total[1:] - hit - np.repeat(total[ends - n], n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(starts, pa.int32()))


def _found(text: Column, pattern: str, in_bytes: bool, needle: str, gap: bool, dense: bool = False) -> Column:
    size = F.octet_length if in_bytes else F.length
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    # Numbers alone are gathered one by one: each step copies what there is, and copies of texts would take the time.
    def step(acc, x):
        s = acc["at"] + size(x["g"])
        added = F.struct((s + size(x["h"])).alias("at"), F.concat(acc["out"], F.array(s)).alias("out"))
        return F.when(x["h"].isNull(), acc).otherwise(added)  # the last gap has no hit

    # Named once: what stands in a function of arrays is worked out wherever it is named, with its patterns.
    if dense:
        starts = F.arrow_udf(_starts, "array<int>")(F.transform(gaps, size), F.transform(hits, size))
    else:
        starts = F.aggregate(F.arrays_zip(gaps.alias("g"), hits.alias("h")), start, step)["out"]
    if gap:
        made = F.zip_with(F.arrays_zip(hits.alias("t"), F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("gap")), starts, lambda x, s: F.struct(s.alias("s"), (s + size(x["t"])).alias("e"), x["t"].alias("t"), x["gap"].alias("gap")))
    else:
        made = F.zip_with(hits, starts, lambda t, s: F.struct(s.alias("s"), (s + size(t)).alias("e"), t.alias("t")))
    there = F.rlike(text, F.lit(pattern))
    none = F.array().cast("array<struct<s:int,e:int,t:string,gap:string>>" if gap else SPAN)
    return F.when(F.contains(text, F.lit(needle)) & there if needle else there, made).otherwise(none)


def find_token(text: Column, word: str, ignore_case: bool = False) -> Column:
    """array<struct<s, e, t>> in bytes: where a word stands as a whole token (an underscore is part of one); hits may overlap each other.

    Where a text's lower-cased form differs in length, case isn't ignored.
    """
    part, quoted = r"[\p{L}\p{N}_]", re.sub(r"([^\w\s])", r"\\\1", word)

    def hits(flags: str) -> Column:
        ahead = f"{flags}(?<!{part})(?={quoted}(?!{part}))"  # of no width, so that hits may overlap
        gaps = F.split(text, ahead, -1)
        words = F.regexp_extract_all(text, F.lit(f"{flags}(?<!{part})(?=({quoted})(?!{part}))"), F.lit(1))
        first = F.rlike(text, F.lit(f"{flags}^{quoted}(?!{part})"))  # a split never makes an empty first part
        inner = F.slice(gaps, F.lit(1), F.size(gaps) - 1)
        none = F.array().cast("array<int>")
        begins = F.aggregate(inner, F.when(first, F.array(F.lit(0))).otherwise(none), lambda acc, g: F.concat(acc, F.array(F.octet_length(g))))
        places = F.aggregate(begins, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")))["out"]
        found = F.zip_with(places, words, lambda s, t: F.struct(s.alias("s"), (s + F.octet_length(t)).alias("e"), t.alias("t")))
        return F.when(F.rlike(text, F.lit(ahead)), found).otherwise(F.array().cast(SPAN))

    if not ignore_case:
        return hits("")
    return F.when(F.octet_length(F.lower(text)) == F.octet_length(text), hits("(?iu)")).otherwise(hits(""))


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def select(spans: Column, element: str) -> Column:
    """Greedy choice from the left of spans in order of their start: a span stays if it begins where the last chosen one has ended."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))["e"]
    return F.aggregate(spans, F.array().cast(f"array<{element}>"), lambda acc, x: F.when(x["s"] < F.coalesce(last(acc), x["s"]), acc).otherwise(F.concat(acc, F.array(x))))


class _Disjoint:
    """Spans that don't overlap each other, in order."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []

    def meets(self, s: int, e: int) -> bool:
        k = bisect_left(self.spans, (e,)) - 1  # the last that starts before e
        return k >= 0 and self.spans[k][1] > s

    def add(self, s: int, e: int) -> None:
        self.spans.insert(bisect_left(self.spans, (s, e)), (s, e))


def _ranked(s: list[int], e: list[int], strong: list[bool], standing: int, guards: list[tuple[int, int]]) -> list[int]:
    guarded, firm, weak, out = _Disjoint(), _Disjoint(), _Disjoint(), []
    for a, b in sorted(guards):  # those that overlap become one
        if guarded.spans and a < guarded.spans[-1][1]:
            a, b = guarded.spans[-1][0], max(guarded.spans.pop()[1], b)
        guarded.spans.append((a, b))
    for k, (a, b, f) in enumerate(zip(s, e, strong)):
        if k >= standing and (guarded.meets(a, b) or firm.meets(a, b) or not f and weak.meets(a, b)):
            continue
        out.append(k)
        (firm if f else weak).add(a, b)
    return out


def ranked(spans: pa.Array, strong: pa.Array, standing: pa.Array, guarded: pa.Array) -> pa.Array:
    """For workers: the spans that stand, of each row's in order of their rank (list<struct<s, e, ...>>).

    Each looks for a span that it overlaps among those that stand by then, by binary search. Strong spans (a flag for each of all rows'
    spans) yield to strong and guarded ones, weak ones to all. The first ``standing`` ones of a row stand anyhow. Null lists count as empty.
    """

    def cut(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return lists.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])

    def places(flat: pa.Array) -> tuple[list[int], list[int]]:
        return flat.field("s").to_pylist(), flat.field("e").to_pylist()

    (flat, at), (fences, fence) = cut(spans), cut(guarded)
    (s, e), (fs, fe), strong, standing = places(flat), places(fences), strong.to_pylist(), pc.fill_null(standing, 0).to_pylist()
    kept, sizes = [], [0]
    for k, (a, b, ga, gb) in enumerate(zip(at, at[1:], fence, fence[1:])):
        kept += [a + x for x in _ranked(s[a:b], e[a:b], strong[a:b], standing[k], list(zip(fs[ga:gb], fe[ga:gb])))] if b > a else []
        sizes.append(len(kept))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat.take(pa.array(kept, pa.int64())))


def without(spans: Column, claimed: Column) -> Column:
    """The spans that overlap no claimed one (an interval anti-join within a row)."""
    return F.filter(spans, lambda x: ~F.exists(claimed, lambda y: overlaps(x, y)))


def edit_error(text: Column, edits: Column) -> Column:
    """Why edits (array<struct<s, e, r>>, code points) can't be applied: inverted, out of bounds or overlapping; null if they can."""
    ordered = F.array_sort(edits)
    following = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1)))
    clash = F.exists(F.zip_with(ordered, following, lambda a, b: F.coalesce(b["s"] < a["e"], F.lit(False))), lambda x: x)
    return F.when(F.exists(edits, lambda x: x["s"] > x["e"]), "inverted").when(F.exists(edits, lambda x: (x["s"] < 0) | (x["e"] > F.length(text))), "out of bounds").when(clash, "overlapping")


def apply(text: Column, edits: Column) -> Column:
    """The text with valid edits applied; null where edit_error tells one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        return F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["r"])).alias("out"))

    done = F.aggregate(F.array_sort(edits), start, step)
    whole = F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(edit_error(text, edits).isNull(), whole)


def source_offset(findings: Column, offset: Column) -> Column:
    """Maps an offset in redacted text to the original: findings are array<struct<s, e, r>> by start, r the marker put for [s, e)."""
    start = F.struct(F.lit(0).alias("gone"), F.lit(None).cast("int").alias("inside"))

    # gone: how much longer the redacted text is so far; negative where it is shorter
    end = F.aggregate(findings, start, lambda acc, f: F.struct(
        F.when(offset >= f["s"] + acc["gone"] + F.length(f["r"]), acc["gone"] + F.length(f["r"]) - (f["e"] - f["s"])).otherwise(acc["gone"]).alias("gone"),
        F.when((offset >= f["s"] + acc["gone"]) & (offset < f["s"] + acc["gone"] + F.length(f["r"])), f["s"]).otherwise(acc["inside"]).alias("inside"),
    ))
    return F.coalesce(end["inside"], offset - end["gone"])
