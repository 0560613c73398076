"""The index by pieces gives what one automaton gives; and it takes dictionaries that no automaton should hold."""

import random

import pytest
from pyspark.sql import functions as F

from twinframe.operators import detect, dictionary, gate

WORDS = ["plan", "Tier", "HTTP", "server", "Acme", "é", "straße", "x", "Ost", "node", "漢字", "billing", "ab"]


def some_names(rng, n):
    return sorted({rng.choice(["", "_", " ", "-"]).join(rng.choice(WORDS).capitalize() for _ in range(rng.randrange(1, 4))) for _ in range(n)} | {"x", "ab", "Acme Corp", "Acme"})


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    names = some_names(rng, 60)
    pool = [v for n in names for v in detect.spellings(n)] + WORDS + ["and", "of", "Xacme", "acmecorp9", ",", "_", "\n"]
    texts = ["".join(rng.choice(pool) + rng.choice(["", " ", "_", "."]) for _ in range(rng.randrange(60))) for _ in range(120)] + [None, "", " ".join(pool * 40)]
    docs = spark.createDataFrame([(k % 50, t) for k, t in enumerate(texts)], "_row long, text string")
    kinds = ["organization", "column", "product", "dto"]
    terms = spark.createDataFrame([(n, kinds[k % 4]) for k, n in enumerate(names)] + [(names[0], "zzz"), (None, "dto"), ("", "dto")], "real_name string, entity_type string")
    return docs, terms


def rows_of(df, *columns):
    return sorted((repr(tuple(r)) for r in df.select("_row", "text", *columns).collect()))


@pytest.mark.parametrize("variants", [True, False])
def test_matches_are_those_of_one_automaton(corpus, monkeypatch, variants):
    docs, terms = corpus
    allow = frozenset(["acme", "PLAN"])
    few = rows_of(detect.dictionary_matches(docs, terms, allow, variants), "terms", "variants")
    monkeypatch.setattr(detect, "MAX_TERMS", 3)
    assert rows_of(detect.dictionary_matches(docs, terms, allow, variants), "terms", "variants") == few
    assert sum("column" in r for r in few) > 5


def test_leaks_are_those_of_one_automaton(corpus, monkeypatch):
    docs, terms = corpus
    few = rows_of(gate.places(docs, terms, ["x"]), "leaks")
    monkeypatch.setattr(gate, "MAX_NAMES", 3)
    monkeypatch.setattr(dictionary, "MAX_BITS", 1 << 10)  # a filter that lets much through loses nothing
    assert rows_of(gate.places(docs, terms, ["x"]), "leaks") == few
    assert sum("matched" in r for r in few) > 50


def test_two_million_names(spark):
    names = spark.range(2_000_000).select(F.concat(F.lit("Vantor"), F.lpad(F.col("id").cast("string"), 7, "0"), F.lit("Works")).alias("real_name"), F.lit("organization").alias("entity_type"))
    texts = [(0, "see Vantor0000000Works, Vantor1999999Works and Vantor2000000Works"), (1, "vantor0000001works Vantor000Works"), (2, None)]
    docs = spark.createDataFrame(texts, "k int, text string")
    got = {r.k: [(x.t, x.s) for x in r.terms] for r in detect.dictionary_matches(docs, names, variants=False).collect()}
    assert got == {0: [("Vantor0000000Works", 4), ("Vantor1999999Works", 24)], 1: [], 2: []}
