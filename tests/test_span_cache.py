"""The span cache: buckets, runs, versions."""

import time

from pyspark.sql import functions as F

from maskweave.operators import span_cache as SC

def batch(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint")
    spans = F.expr("array(named_struct('start', 0L, 'end', 1L, 'label', 'L'))")
    return rows.select(F.sha2(F.col("id").cast("string"), 256).alias("seg_hash"), spans.alias("spans"))


def hashes(df):
    return sorted(r["seg_hash"] for r in df.select("seg_hash").collect())


def test_known_rows_after_any_number_of_batches(spark, tmp_path):
    cache = SC.SpanCache(spark, str(tmp_path / "cache"), fan=3)
    for n in range(20):
        cache.compact("v1", n)
        assert hashes(cache.known("v1", n, batch(spark, range(2 * n + 1)))) == hashes(batch(spark, range(2 * n)))
        cache.append("v1", n, batch(spark, range(2 * n, 2 * n + 2)))
        # Logarithmically many runs, each row once in them.
        assert len(cache.runs("v1", n + 1)) <= 3 * 4
        assert cache.rows("v1", n + 1).count() == 2 * n + 2
    assert hashes(cache.known("v1", 10, batch(spark, range(40)))) == hashes(batch(spark, range(18)))
    assert cache.known("v2", 20, batch(spark, range(3))).count() == 0


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    cache = SC.SpanCache(spark, str(tmp_path / "cache"), fan=2)
    for n in range(4):
        cache.append("v1", n, batch(spark, [n]))
    cache.compact("v1", 4)
    cache.append("v1", 3, batch(spark, [3]))  # its first run has been merged already
    assert hashes(cache.known("v1", 4, batch(spark, range(9)))) == hashes(batch(spark, range(4)))
    cache.compact("v1", 4)
    assert hashes(cache.known("v1", 4, batch(spark, range(9)))) == hashes(batch(spark, range(4)))
    cache.append("v1", 4, batch(spark, []))
    assert cache.known("v1", 5, batch(spark, [])).count() == 0


def test_an_incomplete_run_does_not_count(spark, tmp_path):
    cache = SC.SpanCache(spark, str(tmp_path / "cache"), fan=2)
    for n in range(2):
        cache.append("v1", n, batch(spark, [n]))
    (tmp_path / "cache/policy_version=v1/run=1-0").mkdir()
    assert hashes(cache.rows("v1", 2)) == hashes(batch(spark, range(2)))
    assert cache.compact("v1", 2) == 1
    assert cache.runs("v1", 2) == [(1, 0)]
    assert hashes(cache.rows("v1", 2)) == hashes(batch(spark, range(2)))


def test_only_buckets_of_the_batch_are_read(spark, tmp_path):
    cache = SC.SpanCache(spark, str(tmp_path / "cache"))
    cache.append("v1", 0, batch(spark, range(2000)))
    asked = batch(spark, [5, 6])
    known = cache.known("v1", 1, asked)
    assert known.count() == 2
    scan = next(
        line for line in known._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line
    )
    assert "bucket" in scan.split("PartitionFilters")[1]
    wanted = {r[0] for r in asked.select(SC.bucket(F.col("seg_hash"))).collect()}
    files = {r[0] for r in cache.rows("v1", 1, sorted(wanted)).select(F.input_file_name()).distinct().collect()}
    assert 1 <= len(files) <= len(wanted) <= 2


def test_old_versions_go(spark, tmp_path):
    cache = SC.SpanCache(spark, str(tmp_path / "cache"))
    for v in ("v1", "v2", "v3"):
        cache.append(v, 0, batch(spark, [1]))
    cache.keep_versions(["v2", "v3"])
    assert cache.versions() == ["v2", "v3"]


def test_the_two_hundredth_batch_costs_as_the_first(spark, tmp_path):
    """Runs read by a batch grow with the logarithm; so does, within noise, its time."""
    cache = SC.SpanCache(spark, str(tmp_path / "cache"))
    template = str(tmp_path / "template")
    batch(spark, range(30)).select("seg_hash", "spans", SC.bucket(F.col("seg_hash")).alias("bucket")).where(
        "bucket < 20"
    ).write.partitionBy("bucket").parquet(template)
    import shutil

    seconds = {}
    for n in range(200):
        if n in (8, 199):
            start = time.time()
            cache.known("v1", n, batch(spark, range(4))).count()
            seconds[n] = time.time() - start
        if (n + 1) % SC.FAN == 0:
            cache.compact("v1", n + 1)
        shutil.copytree(template, f"{tmp_path}/cache/policy_version=v1/run=0-{n}")
    assert len(cache.runs("v1", 199)) <= 2 * SC.FAN
    assert seconds[199] < 4 * seconds[8] + 2
