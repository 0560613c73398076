"""Stages that decide by row number lose no text when cores come or go between building and reading."""

import pytest
from pyspark.sql import functions as F

from twinframe.llm import decontamination, exact_dedup, near_dedup

PARALLEL, COST = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes"


@pytest.fixture
def docs(spark, tmp_path):
    """3,000 texts, a tenth of them copied, in files that more cores cut into more parts."""
    d = spark.range(3_000).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.sha2(F.concat("id", F.lit("-"), k).cast("string"), 256)), " ").alias("text"))
    again = d.where("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 10_000)
    path = str(tmp_path / "docs")
    d.union(again).repartition(2).write.option("parquet.block.size", 1 << 20).parquet(path)
    return spark.read.parquet(path)


def bench(spark):
    words = " ".join(f"unseen{k}" for k in range(20))
    return spark.createDataFrame([(1, words)], "item_id long, text string")


@pytest.mark.parametrize("stage", ["exact", "near", "decontamination"])
def test_other_cores_between_building_and_reading(spark, docs, stage):
    run = {"exact": exact_dedup.deduplicated, "near": lambda d: near_dedup.deduplicated(d, 80), "decontamination": lambda d: decontamination.decontaminate(d, bench(spark))}[stage]
    want = 3_300 if stage == "decontamination" else 3_000
    try:
        spark.conf.set(COST, "1000")
        spark.conf.set(PARALLEL, 2)
        few = docs.rdd.getNumPartitions()
        out = run(docs)
        spark.conf.set(PARALLEL, 32)
        assert spark.read.parquet(docs.inputFiles()[0].rsplit("/", 1)[0]).rdd.getNumPartitions() > few
        assert out.count() == want
        assert out.select("text").distinct().count() == 3_000
    finally:
        spark.conf.unset(PARALLEL)
        spark.conf.unset(COST)
