"""Queries of jobs: made row by row, also where several rows have one id."""

from pyspark.sql import functions as F

from sitelens.operators import candidates as C

JOBS = "job_id long, market string, language string, categories array<string>, keywords array<string>, maximum_queries int"


def test_texts_are_not_sorted_across_jobs(spark):
    """What a task holds follows the rows of jobs, not their texts: no window sorts texts of ids that one row has."""
    jobs = spark.range(20_000).select(
        F.col("id").alias("job_id"), F.lit("France").alias("market"), F.lit("en").alias("language"), F.array(F.lit("pc gaming"), F.lit("PC Gaming"), F.lit("esports")).alias("categories"),
        F.array(F.lit("x")).alias("keywords"), F.lit(16).alias("maximum_queries"),
    )
    d = C.generate_queries(jobs)
    row = d.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("seqs"), F.max("seq").alias("last"), F.count_if(F.col("page") == 2).alias("second")).drop("job_id").distinct().collect()
    assert [tuple(r) for r in row] == [(16, 16, 16, 1)]
    # of the two branches below the union, the first holds ids of one row each
    union = d._jdf.queryExecution().optimizedPlan()
    while union.nodeName() != "Union":
        union = union.children().apply(0)
    assert union.children().apply(0).toString().count("Window") == 1


def test_repeated_and_null_ids_make_one_job(spark):
    rows = [(i, m, l, c, k, 40) for i, m, l, c, k in ((1, "JP", "en", ["esports", None], ["a", " A", "b"]), (2, "France", None, None, ["x"]), (None, "Japan", "ja", ["ESPORTS", "esports"], None))]
    once, twice = (C.generate_queries(spark.createDataFrame(r, JOBS)) for r in (rows, rows * 2))
    assert once.count() == 120 and once.exceptAll(twice).count() == 0 and twice.count() == 120
