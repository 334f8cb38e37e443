"""Discovery as a stream: each micro-batch is filtered, de-duplicated and judged against known sites and earlier batches.

Whether a site has been seen is keyed state: a batch looks up the sites of its own hits in the state store and reads no
earlier batch. What it writes is its part of a log of judged candidates. The tables of sites and of sources are derived
from the log by the batch operators. Spark goes back to the state before a batch that failed, and the batch overwrites
its own part of the log, so running again leaves nothing twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.lists import MULTITENANT
from ..operators.candidates import dedup_candidates, insert_if_absent, split_candidates, upsert_websites

SITES = "canonical_key string, name string, description string, homepage_url string"
SOURCES = "canonical_key string, query_text string, url string, seq long"
LOG = "canonical_key string, name string, description string, homepage_url string, query_text string, url string, seq long, outcome string"


def judged_candidates(hits: DataFrame, seen: DataFrame, known: DataFrame, multitenant: Sequence[str] = MULTITENANT, new_only: bool = True) -> DataFrame:
    """The kept candidate of each site in ``hits``, in the columns of LOG.

    outcome is duplicate if ``seen`` has the site; else, if ``known`` has it, known (updated unless ``new_only``); else
    new. ``seen`` and ``known`` have no canonical_key twice. ``hits`` may lack name and description.
    """
    accepted, _ = split_candidates(hits, multitenant)
    kept = dedup_candidates(accepted).where("kept")
    marked = kept.join(seen.select("canonical_key", F.lit(True).alias("_seen")), "canonical_key", "left").join(known.select("canonical_key", F.lit(True).alias("_known")), "canonical_key", "left")
    outcome = F.when(F.col("_seen"), "duplicate").when(F.col("_known"), "known" if new_only else "updated").otherwise("new")
    given = [F.col(c) if c in kept.columns else F.lit(None).cast("string").alias(c) for c in ("name", "description")]
    return marked.select("canonical_key", *given, "homepage_url", "query_text", "url", "seq", outcome.alias("outcome"))


def _judge(new_only: bool):
    """The function of one site's rows and state: the kept candidate of its hits in this batch, as ``judged_candidates`` has it."""

    def judge(key, frames, state):
        import pandas as pd

        first, secure, known = None, {}, False
        for rows in frames:
            known = known or bool(rows["known"].iloc[0])
            ordered = rows.sort_values("seq")
            if first is None or ordered["seq"].iloc[0] < first["seq"]:
                first = ordered.iloc[0]
            # the first https row of each query and position; one of them may replace an http row
            for row in ordered[ordered["normalized_url"].str.startswith("https:")].drop_duplicates(["query_text", "position"]).to_dict("records"):
                place = (row["query_text"], row["position"])
                if place not in secure or row["seq"] < secure[place]["seq"]:
                    secure[place] = row
        kept = dict(first)
        if kept["normalized_url"].startswith("http:"):
            kept = secure.get((kept["query_text"], kept["position"]), kept)
        kept["outcome"] = "duplicate" if state.exists else ("known" if new_only else "updated") if known else "new"
        state.update((True,))
        yield pd.DataFrame([{c: kept[c] for c in _LOG_COLUMNS}])

    return judge


_LOG_COLUMNS = [c.split()[0] for c in LOG.split(", ")]


def stored_log(spark: SparkSession, folder: str) -> DataFrame:
    """Judged candidates of all batches."""
    return spark.read.schema(f"{LOG}, batch int").option("ignoreMissingFiles", True).parquet(f"{folder}/log")


def _taken(log: DataFrame) -> DataFrame:
    return log.where(F.col("outcome").isin("new", "updated"))


def stored_sites(spark: SparkSession, folder: str, websites: DataFrame | None = None) -> DataFrame:
    """``websites`` with the new sites of the stream added and empty fields of updated ones filled."""
    known = spark.createDataFrame([], SITES) if websites is None else websites
    return upsert_websites(known, _taken(stored_log(spark, folder)))


def stored_sources(spark: SparkSession, folder: str, sources: DataFrame | None = None) -> DataFrame:
    """``sources`` and the hits through which the stream's sites were found, once for each site, query and URL."""
    have = spark.createDataFrame([], SOURCES) if sources is None else sources
    return insert_if_absent(have, _taken(stored_log(spark, folder)), ["canonical_key", "query_text", "url"])


def discover_stream(
    hits: DataFrame, folder: str, multitenant: Sequence[str] = MULTITENANT, websites: DataFrame | None = None, new_only: bool = True
) -> StreamingQuery:
    """Run all available micro-batches of ``hits`` (seq, url, query_text, position; name and description if any) into the log in ``folder``.

    ``websites`` are the sites known before the run. If batches come in the order of seq and hold whole queries, the
    tables after the last batch are those of one batch with all hits. State grows by a flag a site; give
    ``spark.sql.streaming.stateStore.providerClass`` a store on disk for very many. A site's hits of one batch are read
    in frames, and what is held of them is a row for each query and position.
    """
    spark = hits.sparkSession
    known = (spark.createDataFrame([], SITES) if websites is None else websites).select("canonical_key", F.lit(True).alias("known")).distinct()
    spark.createDataFrame([], LOG).write.mode("ignore").parquet(f"{folder}/log/batch=-1")
    accepted, _ = split_candidates(hits, multitenant)
    given = [F.col(c) if c in accepted.columns else F.lit(None).cast("string").alias(c) for c in ("name", "description")]
    rows = accepted.join(known, "canonical_key", "left").select(
        "canonical_key", *given, "homepage_url", "query_text", "url", "seq", "position", "normalized_url", F.coalesce("known", F.lit(False)).alias("known")
    )
    judged = rows.groupBy("canonical_key").applyInPandasWithState(_judge(new_only), LOG, "seen boolean", "append", GroupStateTimeout.NoTimeout)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/log/batch={batch_id}")

    return judged.writeStream.foreachBatch(store).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
