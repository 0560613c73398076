"""What workers are handed at once has a bound, whatever the table."""

from pyspark.sql import functions as F

from twinframe.operators import detect, gate
from twinframe.queries import QUERIES
from twinframe.sources import rows

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_batches_are_bounded(spark, sf_dir):
    docs, names = spark.createDataFrame([(1, "Acme Corp")], "doc_id long, text string"), spark.createDataFrame([("Acme Corp",)], "real_name string")
    before = spark.conf.get(KEY)
    try:
        for use in (lambda: gate.places(docs, names), lambda: detect.dictionary_matches(docs, {"Acme": "brand"}), lambda: QUERIES["span_conflict"](spark, sf_dir)):
            spark.conf.set(KEY, "10000")
            use()
            assert int(spark.conf.get(KEY)) == rows.BATCH_ROWS
        spark.conf.set(KEY, "100")  # a smaller bound of the caller's own stays
        gate.places(docs, names)
        assert spark.conf.get(KEY) == "100"
    finally:
        spark.conf.set(KEY, before)


def test_letters_are_lowered_as_by_translation():
    for text in ("", "Abc", "ÀB é漢字Z\x00", "Straße İ \U0001f600Q"):
        assert detect.ascii_lower(text) == text.translate(detect.ASCII_LOWER)


def test_protected_spans_begin_where_they_may(spark):
    text = "x<<REDACTED:email>> ORG_001, xORG_2 ORG_3x <<REDACTED:a"
    d = spark.createDataFrame([(text,)], "t string")
    assert [x.t for x in d.select(detect.protected(F.col("t")).alias("x")).first().x] == ["<<REDACTED:email>>", "ORG_001", "<<REDACTED:a"]
