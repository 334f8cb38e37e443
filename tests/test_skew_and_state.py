"""Hot keys spread over tasks, and a stream whose batches read the state of their own keys only."""

import os
import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter
from test_operators import HITS

from sitelens.operators import candidates as C
from sitelens.operators import reports as R
from sitelens.streaming import discover


@pytest.fixture
def plain(spark):
    """No adaptive execution and no broadcast joins, so that partitions show how keys are dealt."""
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_hot_site_is_spread(plain):
    hit = F.struct(F.when(F.col("id") % 3 == 0, "hot.com").otherwise(F.concat(F.lit("s"), F.col("id") % 997, F.lit(".com"))).alias("canonical_key"), F.col("id").alias("seq"), (F.col("id") % 7).alias("query_seq"))
    rows = plain.range(30_000).select(hit.alias("h")).select("h.*", F.lit("q").alias("query_text"), F.lit(1).alias("position"), F.concat(F.lit("http://"), F.col("canonical_key"), F.col("seq")).alias("normalized_url"))
    for f in (C.dedup_candidates, C.dedup_across_queries):
        usual, spread = f(rows), f(rows, hot_rows=500)
        assert max(sizes(usual)) > 10_000 and max(sizes(spread)) < 4_000
        assert sorted(map(str, usual.collect())) == sorted(map(str, spread.collect()))


def test_site_of_many_jobs(spark):
    sources = spark.createDataFrame([(j, s, "q") for j in range(40) for s in ("a", "b")], "job_id int, site string, query string")
    checks = spark.createDataFrame([("a", "verified", 1, 1, 1)], "site string, status string, attempt int, verified_at int, id int")
    got = R.job_results(sources.select("job_id").distinct(), sources, checks).collect()
    assert {(r.site, r.status) for r in got} == {("a", "verified"), ("b", None)} and len(got) == 80


def written(spark, tmp_path, batches=4):
    rows = [(i, i // 10, f"http{'s' if i % 3 else ''}://s{i * i % 11}.com/{i}", f"q{i // 10}", i % 4) for i in range(10 * batches)]
    df = spark.createDataFrame(rows, HITS)
    for k in range(batches):
        df.where(F.col("query_seq") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, lambda: spark.readStream.schema(HITS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def by_batch(df):
    accepted, _ = C.split_candidates(df)
    own = C.dedup_across_queries(C.dedup_candidates(accepted).where("kept")).where("not duplicate")
    return sorted((r.canonical_key, r.url, r.seq) for r in own.collect())


def found(spark, out):
    return sorted((r.canonical_key, r.url, r.seq) for r in discover.stored_log(spark, out).where("outcome = 'new'").collect())


def test_batches_do_not_read_the_log(spark, tmp_path):
    """The log's earlier batches are taken away between runs; what later ones find stays right."""
    df, stream = written(spark, tmp_path, 2)
    out = str(tmp_path / "out")
    discover.discover_stream(stream(), out).awaitTermination()
    kept = found(spark, out)
    for name in ("batch=0", "batch=1"):
        shutil.move(f"{out}/log/{name}", str(tmp_path / name))
    more = df.withColumn("seq", F.col("seq") + 100).withColumn("query_seq", F.lit(9)).unionByName(spark.createDataFrame([(200, 9, "https://fresh.com/", "q", 1)], HITS))
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = discover.discover_stream(stream(), out)
    query.awaitTermination()
    assert found(spark, out) == [("fresh.com", "https://fresh.com/", 200)]
    state = query.lastProgress.stateOperators[0]
    assert state.numRowsTotal == len(kept) + 1
    for name in ("batch=0", "batch=1"):
        shutil.move(str(tmp_path / name), f"{out}/log/{name}")
    assert found(spark, out) == sorted([*kept, ("fresh.com", "https://fresh.com/", 200)])


def test_restart_after_a_failed_batch(spark, tmp_path, monkeypatch):
    """The third batch fails once its rows are written; it runs again with the state before it."""
    df, stream = written(spark, tmp_path)
    out = str(tmp_path / "out")
    write = DataFrameWriter.parquet

    def fails(self, path, *args, **kwargs):
        write(self, path, *args, **kwargs)
        if path.endswith("batch=2"):
            raise OSError("lost")

    monkeypatch.setattr(DataFrameWriter, "parquet", fails)
    with pytest.raises(StreamingQueryException):
        discover.discover_stream(stream(), out).awaitTermination()
    monkeypatch.undo()
    assert not os.path.exists(f"{out}/log/batch=3")
    discover.discover_stream(stream(), out).awaitTermination()
    assert found(spark, out) == by_batch(df)
    discover.discover_stream(stream(), out).awaitTermination()
    assert found(spark, out) == by_batch(df)
