"""Tables stored as versioned snapshots: a new version is written beside the old ones and becomes current with one commit.

``folder/data/<name>`` holds a version's rows, ``folder/commits/version=<n>`` one row that names it, written by a Spark job
of its own after the data. A reader takes the version of the highest commit, so it sees the old table or the new one and
never a part of either. A job that fails before its commit leaves data that no one reads; run again, it writes new data.
One writer at a time: a commit whose version exists already fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.candidates import insert_if_absent, upsert_websites
from ..operators.contacts import upsert_contacts

_COMMIT = "data string, token string"


class Version(NamedTuple):
    number: int
    data: str
    token: str | None


def versions(spark: SparkSession, folder: str) -> list[Version]:
    """Committed versions, the current one last. One small row each is read."""
    try:
        rows = spark.read.schema(f"{_COMMIT}, version long").json(f"{folder}/commits").where("data is not null").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(Version(r.version, r.data, r.token) for r in rows)


def read_snapshot(spark: SparkSession, folder: str, schema: str | T.StructType, number: int | None = None) -> DataFrame:
    """The current version of the table, or version ``number``; empty if nothing has been committed."""
    known = versions(spark, folder)
    if number is not None:
        known = [v for v in known if v.number == number]
        if not known:
            raise ValueError(f"no version {number}")
    return spark.read.schema(schema).parquet(f"{folder}/data/{known[-1].data}") if known else spark.createDataFrame([], schema)


def write_snapshot(df: DataFrame, folder: str, token: str | None = None) -> int:
    """Write ``df`` as the next version and commit it; its number. A ``token`` that has been committed writes nothing and gives the number it has."""
    spark = df.sparkSession
    known = versions(spark, folder)
    if token is not None:
        for v in known:
            if v.token == token:
                return v.number
    number, data = (known[-1].number + 1 if known else 1), uuid.uuid4().hex
    df.write.mode("error").parquet(f"{folder}/data/{data}")
    spark.createDataFrame([(data, token)], _COMMIT).coalesce(1).write.mode("error").json(f"{folder}/commits/version={number}")
    return number


def update_snapshot(spark: SparkSession, folder: str, schema: str, change: Callable[[DataFrame], DataFrame], token: str | None = None) -> int:
    """Commit ``change`` of the current version as the next one. The old version's files stay as they are while they are read."""
    return write_snapshot(change(read_snapshot(spark, folder, schema)), folder, token)


WEBSITES = "canonical_key string, name string, description string, homepage_url string"


def store_websites(found: DataFrame, folder: str, token: str | None = None) -> int:
    """The stored websites with new ones added and empty fields of known ones filled."""
    return update_snapshot(found.sparkSession, folder, WEBSITES, lambda old: upsert_websites(old, found), token)


def store_new(rows: DataFrame, folder: str, keys: Sequence[str], order: str = "seq", token: str | None = None) -> int:
    """The stored rows and those of ``rows`` whose ``keys`` they lack, the first by ``order`` of each."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    return update_snapshot(rows.sparkSession, folder, schema, lambda old: insert_if_absent(old, rows, keys, order), token)


def store_contacts(contacts: DataFrame, folder: str, key: str = "contact_key", token: str | None = None) -> int:
    """The stored contacts, replaced where a new one of the same key is more confident."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in contacts.schema.fields])
    return update_snapshot(contacts.sparkSession, folder, schema, lambda old: upsert_contacts(old, contacts, key), token)


def contact_changes(spark: SparkSession, folder: str, contacts: DataFrame, key: str = "contact_key") -> DataFrame:
    """One row: how many of the distinct keys of ``contacts`` are new to the stored table (created) and how many it has (reused)."""
    old = read_snapshot(spark, folder, contacts.schema).select(key, F.lit(True).alias("__old")).distinct()
    d = contacts.select(key).distinct().join(old, key, "left")
    return d.agg(F.count_if(F.col("__old").isNull()).alias("created"), F.count_if("__old").alias("reused"))
