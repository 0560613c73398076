"""Identity detection: passes that offer candidate spans, and the rule that settles conflicts between them."""

from __future__ import annotations

import re
import string
from collections.abc import Collection, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe import vocab
from twinframe.functions import spans, text as fn
from twinframe.operators import dictionary
from twinframe.sources import rows

# What hosts, compounds, variables, phrases and people look like.
HOST = r"\b[a-z0-9][a-z0-9-]*(?:\.[a-z0-9][a-z0-9-]*){2,}\b"
TLD = r"\.[a-z]{2,}$"
PASCAL = r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b"
SCREAMING = r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"
PHRASE = r"\b[A-Z][a-z]{2,}(?:[ \t]+[A-Z][a-z]{2,})*\b"
PERSON = r"(?i)(?:^|[\s*/#@-])(?:" + "|".join(vocab.PERSON_MARKERS) + r")[ \t]*[:=@]?[ \t]+((?-i:[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){1,2}))"


def one_of(names: Collection[str]) -> str:
    """A pattern of names in any case, the longest that stands at a place: four letters are looked at before the names, which are kept by their first."""
    first = lambda k: "[" + re.escape("".join(sorted({n[k].lower() for n in names}))) + "]"
    by: dict[str, list[str]] = {}
    for n in sorted(names, key=lambda n: (-len(n), n)):
        by.setdefault(n[0].lower(), []).append(n[1:].replace(".", r"\."))
    return f"(?i)(?={''.join(map(first, range(min(4, *map(len, names)))))})(?:{'|'.join(f'{k}(?:{chr(124).join(v)})' for k, v in sorted(by.items()))})"


VENDOR = one_of(vocab.PAYMENT_PROVIDERS + vocab.PARTNERS)
PROTECTED = r"(?=[<A-Z])(?:<<REDACTED:(?:(?!>>)[\s\S])*(?:>>|$)|(?<![A-Za-z0-9_])(?:" + fn._PREFIXES + r")_[0-9]+(?![A-Za-z0-9_]))"
CANDIDATE = "struct<s:int,e:int,t:string,type:string,confidence:double,scope:string>"
CONFIDENT = 0.8


def typed(found: Column, kind, confidence) -> Column:
    kind = kind if callable(kind) else lambda t, k=kind: F.lit(k)
    confidence = confidence if callable(confidence) else lambda t, c=confidence: F.lit(c)
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), kind(x["t"]).cast("string").alias("type"), confidence(x["t"]).cast("double").alias("confidence"), F.lit("").alias("scope")))


def hosts(text: Column) -> Column:
    """Names of three labels or more whose last is letters; versions and addresses aren't."""
    return F.filter(spans.find(text, HOST), lambda x: F.rlike(x["t"], F.lit(TLD)))


def vendors(text: Column) -> Column:
    paying = [v.lower() for v in vocab.PAYMENT_PROVIDERS]
    return typed(spans.find(text, VENDOR), lambda t: F.when(F.lower(t).isin(paying), "payment_provider").otherwise("partner"), 0.95)


def persons(text: Column) -> Column:
    """Names after a marker on the same line; the span is the name alone."""
    hits = spans.find(text, PERSON)
    name = lambda t: F.regexp_extract(t, PERSON, 1)
    return F.transform(hits, lambda x: F.struct((x["e"] - F.octet_length(name(x["t"]))).alias("s"), x["e"].alias("e"), name(x["t"]).alias("t"), F.lit("person").alias("type"), F.lit(0.9).alias("confidence"), F.lit("").alias("scope")))


def env_vars(text: Column) -> Column:
    return typed(F.filter(spans.find(text, SCREAMING), lambda x: ~x["t"].isin(*vocab.STOP_LIST)), "env_var", 0.9)


def compounds(text: Column) -> Column:
    found = F.filter(spans.find(text, PASCAL), lambda x: ~x["t"].isin(*vocab.STOP_LIST))
    return typed(found, lambda t: F.coalesce(fn.classify_pascal(t), F.lit("dto")), lambda t: F.when(fn.classify_pascal(t).isNotNull(), 0.85).otherwise(0.8))


def phrases(text: Column) -> Column:
    """Capitalised phrases, suggested only; without ordinary sentence beginnings and bare markers."""
    found = spans.find_after(text, PHRASE)
    alone = lambda x: ~F.rlike(x["t"], F.lit(r"[ \t]"))
    before = lambda x: F.regexp_replace(x["gap"], r"\s+$", "")
    # of a gap of white space alone, what stands before it is the phrase before, or nothing at all
    begins = lambda x: F.rlike(before(x), F.lit(r"[.!?\n#*|-]$")) | ((before(x) == "") & (x["s"] == F.octet_length(x["gap"])))
    noise = lambda x: F.split(x["t"], r"[ \t]+")[0].isin(*vocab.SENTENCE_STARTERS) | (alone(x) & begins(x))
    kept = F.filter(found, lambda x: ~x["t"].isin(*vocab.STOP_LIST) & ~F.lower(x["t"]).isin(*vocab.PERSON_MARKERS) & ~noise(x))
    return typed(kept, "organization", 0.35)


def protected(text: Column) -> Column:
    """Redaction markers and issued aliases, which nothing may touch."""
    return spans.find(text, PROTECTED)


def settle(offered: Column, guarded: Column, already: Column | None = None) -> Column:
    """The conflict rule over candidates in order of pass: identities yield to identities and guarded spans, structure to any claim.

    Candidates of ``already`` stand; the offered ones come after them.
    """
    settled = F.arrow_udf(_settled, f"array<{CANDIDATE}>").asNondeterministic()  # so that no rule copies it
    fences = F.transform(guarded, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    if already is None:
        return F.array_sort(settled(offered, F.lit(0), fences))
    return F.array_sort(settled(F.concat(already, offered), F.size(already), fences))


def _settled(offered: pa.Array, standing: pa.Array, guarded: pa.Array) -> pa.Array:
    strong = pc.is_in(offered.flatten().field("type"), pa.array(sorted(vocab.IDENTITY)))
    return spans.ranked(offered, strong, standing, guarded)


def unlisted(offered: Column, allow: frozenset[str] | None) -> Column:
    """The candidates whose text isn't allowed to stay as it is, in any case. Allowed names are settings, hundreds at most."""
    if not allow:
        return offered
    return F.filter(offered, lambda x: ~F.lower(x["t"]).isin(*sorted(a.lower() for a in allow)))


def scan_text(text: Column, dictionary: Column | None = None, variants: Column | None = None, allow: frozenset[str] | None = None) -> Column:
    """All passes in order: dictionary matches if given, vendors, persons, variables, hosts, compounds, phrases, dictionary variants if given.

    Allowed names come from no pass.
    """
    passes = [vendors(text), persons(text), env_vars(text), typed(hosts(text), "domain", 0.9), compounds(text), phrases(text)]
    offered = F.concat(*(x for x in (dictionary, *passes, variants) if x is not None))
    return settle(unlisted(offered, allow), protected(text))


#: Shortest variant in bytes, and what a variant's hit is worth.
VARIANT_BYTES, VARIANT = 4, 0.82
ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def ascii_lower(text: str) -> str:
    """As ``translate(ASCII_LOWER)``, which looks every character of a long text up; bytes know no other letters."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


@lru_cache(4096)
def spellings(name: str) -> list[str]:
    """What ``functions.text.case_variants`` gives, for workers."""
    import regex

    lower = [w.lower() for w in regex.split(r"[^\p{L}\p{N}]+", regex.sub(fn.HUMP, " ", name)) if w]
    if not lower:
        return []
    capital = [w[:1].upper() + w[1:] for w in lower]
    base = {name, "".join(capital), lower[0] + "".join(capital[1:]), *(by.join(lower) for by in "_-. "), "".join(lower).upper(), " ".join(capital), "_".join(lower).upper()}
    return sorted(base | {v + "s" for v in base if not v.endswith("s")})


def _folded_variants(names: dict[str, str], allowed: frozenset[str]) -> dict[str, str]:
    """ASCII-lower-cased variants and the type of their name, that of the first name in order where several share one."""
    out: dict[str, str] = {}
    for name in sorted(names):
        for v in spellings(name):
            if v != name and len(v.encode()) >= VARIANT_BYTES and v.lower() not in allowed:
                out.setdefault(ascii_lower(v), names[name])
    return out


def _bounded(text: str, s: int, e: int, identity: bool) -> bool:
    """Identities may stand inside a compound, at a hump; other names are whole tokens, of which an underscore is part."""
    before, after, first = text[s - 1 : s] if s else "", text[e : e + 1], text[s : s + 1]
    if identity:
        left = not before or not before.isalnum() or first.isupper() and not before.isupper()
        return left and (not after or not after.isalnum() or after.isupper())
    return not (before.isalnum() or before == "_" or after.isalnum() or after == "_")


def _hit(text: str, s: int, e: int, kind: str, confidence: float) -> dict:
    at = len(text[:s].encode())
    return {"s": at, "e": at + len(text[s:e].encode()), "t": text[s:e], "type": kind, "confidence": confidence, "scope": ""}


#: Terms that are sent to the executors as automata; more are joined to the texts by pieces (see operators.dictionary).
MAX_TERMS = 300_000
_MATCHES = f"struct<terms:array<{CANDIDATE}>,variants:array<{CANDIDATE}>>"


def machine(words: dict):
    """An automaton of words, each with its length and value; None of none."""
    import ahocorasick

    m = ahocorasick.Automaton()
    for word, value in words.items():
        m.add_word(word, (len(word), value))
    if words:
        m.make_automaton()
    return m if words else None


def _hits(m, text: str, within: str, confidence: float) -> list[dict]:
    found = ((end + 1 - n, end + 1, kind) for end, (n, kind) in m.iter_long(within)) if m else ()
    return [_hit(text, s, e, kind, confidence) for s, e, kind in found if _bounded(text, s, e, kind in vocab.IDENTITY)]


def _matches(text: str, exact, others, known) -> tuple[list[dict], list[dict]]:
    return _hits(exact, text, text, 1.0), [h for h in _hits(others, text, ascii_lower(text), VARIANT) if h["t"] not in known]


def dictionary_matches(docs: DataFrame, terms: dict[str, str] | DataFrame, allow: frozenset[str] = frozenset(), variants: bool = True) -> DataFrame:
    """Adds ``terms`` and ``variants``: dictionary hits by automata, leftmost longest, with the boundary rule of the term's type.

    Variants are other spellings of a term in any case, each found under its surface text. ``terms`` maps a term to its type, or is a table
    of them (real_name, entity_type; the least type counts), of any size: with more than MAX_TERMS, each text has automata of the terms
    whose pieces it holds, with the same hits. A longest match that fails its boundary consumes its text.
    """
    rows.small_batches(docs.sparkSession)
    folded = frozenset(a.lower() for a in allow)
    if isinstance(terms, DataFrame):
        terms = terms.where("real_name IS NOT NULL AND real_name != ''").groupBy("real_name").agg(F.min("entity_type").alias("entity_type"))
        few = terms.limit(MAX_TERMS + 1).collect()
        if len(few) > MAX_TERMS:
            return _joined_matches(docs, terms, folded, variants)
        terms = {r.real_name: r.entity_type for r in few}
    wanted = {t: k for t, k in terms.items() if t.lower() not in folded and t not in vocab.STOP_LIST}
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    @F.pandas_udf(_MATCHES)
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        exact = machine(shared.value)
        others = machine(_folded_variants(shared.value, folded)) if variants else None
        for batch in batches:
            yield pd.DataFrame([_matches(t or "", exact, others, shared.value) for t in batch], columns=["terms", "variants"])

    return docs.withColumn("_m", match.asNondeterministic()("text")).select(*docs.columns, "_m.terms", "_m.variants")


def spelled(names: DataFrame, fold: bool = True) -> DataFrame:
    """variant and the columns of names (real_name, ...): every spelling of each name, ASCII-lower-cased."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [sorted({v.translate(ASCII_LOWER) for v in spellings(n) if fold or v != n}) for n in batch.column("real_name").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.list_(pa.string()))], names=[*batch.schema.names, "variants"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names.schema)
    return names.mapInArrow(spell, f"{schema}, variants array<string>").select(*names.columns, F.explode("variants").alias("variant"))


def _joined_matches(docs: DataFrame, terms: DataFrame, allowed: frozenset[str], variants: bool) -> DataFrame:
    allowed_ = sorted(allowed)
    wanted = terms.where(~F.lower("real_name").isin(allowed_) & ~F.col("real_name").isin(*vocab.STOP_LIST))
    sides = {"_exact": (wanted.select(F.col("real_name").alias("pattern"), F.col("entity_type").alias("kind")), str)}
    if variants:
        other = spelled(wanted, fold=False).where((F.octet_length("variant") >= VARIANT_BYTES) & ~F.lower("variant").isin(allowed_))
        sides["_other"] = other.groupBy(F.col("variant").alias("pattern")).agg(F.min_by("entity_type", "real_name").alias("kind")), ascii_lower
    row = rows.fresh("_row", docs)
    d = numbered = rows.numbered(docs, row, rows.cut)
    for name, (patterns, fold) in sides.items():
        met = dictionary.candidates(numbered.select(F.col(row).alias("row"), "text"), rows.cut(dictionary.filed(patterns)), fold)
        d = d.join(met.groupBy(F.col("row").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct("pattern", "kind"))).alias(name)), row, "left")

    @F.pandas_udf(_MATCHES)
    def match(texts: pd.Series, exact: pd.Series, other: pd.Series) -> pd.DataFrame:
        found = [_matches(t or "", machine(dict(x or {})), machine(dict(o or {})), dict(x or {})) for t, x, o in zip(texts, exact, other)]
        return pd.DataFrame(found, columns=["terms", "variants"])

    none = F.create_map().cast("map<string,string>")
    found = match.asNondeterministic()(F.col("text"), F.col("_exact"), F.col("_other") if variants else none)
    return d.withColumn("_m", found).select(*docs.columns, "_m.terms", "_m.variants")


def _document_variants(texts: pd.Series, found: pd.Series) -> pd.Series:
    def one(text, names) -> list[dict]:
        words = _folded_variants({x["t"]: x["type"] for x in names if x["confidence"] >= CONFIDENT} if names is not None else {}, frozenset())
        if not text or not words:
            return []
        folded = ascii_lower(text)
        pattern = re.compile(r"(?<![^\W])(?:" + "|".join(map(re.escape, sorted(words, key=lambda w: (-len(w), w)))) + r")(?![^\W])")
        return [_hit(text, m.start(), m.end(), words[m[0]], VARIANT) for m in pattern.finditer(folded)]

    return pd.Series([one(t, x) for t, x in zip(texts, found)])


def in_prose(offered: Column, regions: Column | None) -> Column:
    """The candidates inside one of the regions (array<struct<s, e>>; null: everywhere), and identities wherever they are."""
    if regions is None:
        return offered
    return F.filter(offered, lambda x: regions.isNull() | F.exists(regions, lambda r: (r["s"] <= x["s"]) & (x["e"] <= r["e"])) | fn.is_identity(x["type"]))


def document_variants(text: Column, found: Column, allow: frozenset[str] | None = None, regions: Column | None = None) -> Column:
    """Candidates: whole-token variants of the confident ones among a text's settled candidates."""
    more = F.pandas_udf(_document_variants, f"array<{CANDIDATE}>").asNondeterministic()(text, found)
    return in_prose(unlisted(more, allow), regions)


def with_document_variants(text: Column, found: Column, allow: frozenset[str] | None = None) -> Column:
    """The settled candidates of a text and, where they leave room, ``document_variants``."""
    return settle(document_variants(text, found, allow), protected(text), found)


def should_alias(name: Column, entity_type: Column, confirmed: Column) -> Column:
    """A confirmed term, or an identity type whose name identifies."""
    return confirmed | (fn.is_identity(entity_type) & fn.is_identifying(name))
