"""Spans of patterns that match all over a text, and of many names: the same as the plain way's, in time that grows with the text."""

import random
import re
import time

from pyspark.sql import functions as F

from twinframe import vocab
from twinframe.functions import spans
from twinframe.operators import detect


def test_names_by_first_letter_are_the_alternation():
    names = vocab.PAYMENT_PROVIDERS + vocab.PARTNERS
    plain = re.compile("(?i)" + "|".join(v.replace(".", r"\.") for v in sorted(names, key=lambda v: (-len(v), v))), re.A)
    quick = re.compile(detect.one_of(names), re.A)
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice([rng.choice(names), rng.choice(names).upper(), rng.choice(names)[:-1], "x", " ", "é"]) for _ in range(30))
        assert [m.span() for m in quick.finditer(text)] == [m.span() for m in plain.finditer(text)]


def test_a_pattern_is_worked_out_as_often_as_it_must(spark):
    assert spans.find(F.col("t"), "[a-z]+")._jc.toString().count("regexp_extract_all") == 2  # the hits, and their places


def test_dense_spans_are_those_of_the_jvm(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é.漢 ") for _ in range(rng.randrange(40))) for _ in range(200)] + [None, "", "abc", "..", "a"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    for in_bytes in (True, False):
        one, other = (spans.find(F.col("t"), "[a-z]+", in_bytes, dense=dense) for dense in (False, True))
        assert d.where(~one.eqNullSafe(other)).count() == 0


def test_dense_spans_of_a_long_text(spark):
    n = 300_000
    begun = time.monotonic()
    d = spark.range(1).select(F.expr(f"repeat('word ', {n})").alias("t")).select(spans.find(F.col("t"), "[a-z]+", dense=True).alias("x"))
    assert tuple(d.select(F.size("x"), F.element_at("x", -1)["s"]).first()) == (n, 5 * (n - 1))
    assert time.monotonic() - begun < 30
