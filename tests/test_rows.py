"""Row numbers that outlive a change of the cluster."""

import pytest
from pyspark.sql import functions as F

from twinframe.sources import rows

PARALLEL, COST = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes"


@pytest.fixture
def files(spark, tmp_path):
    path = str(tmp_path / "some files")
    text = F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 512))
    spark.range(40_000).select("id", F.repeat(text, 8).alias("text")).repartition(3).write.option("parquet.block.size", 1 << 20).parquet(path)
    return path


@pytest.mark.parametrize("seeds", [rows.SEEDS, 0])
def test_numbers_stay_when_cores_come_and_go(spark, files, monkeypatch, seeds):
    """By hashes of the files' names, and by a table of them."""
    monkeypatch.setattr(rows, "SEEDS", seeds)
    d = spark.read.parquet(files)
    numbered = rows.numbered(d.where("id % 10 != 3").select("text", "id"), "n", lambda f: f)
    seen, cuts = {}, set()
    spark.conf.set(COST, "1000")
    try:
        for cores in (1, 4, 64):
            spark.conf.set(PARALLEL, cores)
            again = numbered.select("id", "n").toPandas()
            assert again.n.is_unique and len(again) == 36_000
            seen[cores] = dict(zip(again.id, again.n))
            cuts.add(spark.read.parquet(files).rdd.getNumPartitions())
    finally:
        spark.conf.unset(PARALLEL)
        spark.conf.unset(COST)
    assert len(cuts) == 3  # the readings did cut the files differently
    assert seen[1] == seen[4] == seen[64]


def test_what_is_not_a_scan_is_kept_first(spark, files, tmp_path):
    d = spark.read.parquet(files)
    kept = []

    def keep(df):
        kept.append(df.columns)
        df.write.parquet(str(tmp_path / f"kept{len(kept)}"))
        return spark.read.parquet(str(tmp_path / f"kept{len(kept)}"))

    for odd in (d.repartition(2), d.sample(0.5), d.where(F.rand() < 0.5), d.union(d), spark.range(5), d.limit(5)):
        assert not rows.addressable(odd)
        out = rows.numbered(odd, "n", keep)
        assert out.select("n").distinct().count() == out.count()
    assert kept == [[*odd, "n"] for odd in (["id", "text"],) * 4 + (["id"], ["id", "text"])]
    assert rows.addressable(d.select("text").where("length(text) > 5"))
    assert rows.numbered(d.where("id < 0"), "n", keep).count() == 0


def test_ranks_of_a_group_come_from_many_tasks(spark, monkeypatch):
    d = spark.range(20_000).select((F.when(F.col("id") % 100 < 97, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 7))).alias("g"), F.xxhash64("id").alias("k"), F.lit(1).alias("n"))
    d = d.union(spark.createDataFrame([(None, 5, 1), (None, 3, 1)], "g string, k long, n int"))
    want = d.withColumn("r", F.row_number().over(rows.Window.partitionBy("g").orderBy("k")))
    got = rows.ranked(d, "g", F.struct("k"), "r")
    assert got.select("g", "k", F.col("r").cast("int").alias("r")).exceptAll(want.select("g", "k", "r")).isEmpty() and got.count() == 20_002
    tasks = got.where("g = 'big'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and "Window" not in got._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert rows.ranked(d.where("k IS NULL"), "g", F.col("k"), "r").collect() == []
