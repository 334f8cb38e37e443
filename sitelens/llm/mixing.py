"""Mixing sources to target weights with a time-varying curriculum, in DataFrame functions only.

Each source gets a share of the words the mix takes, proportional to its weight and capped at a multiple of its size.
Over training time a source's weight follows a schedule; the integral of the schedule, scaled to the source's target, is
its cumulative demand. A document's copy is needed when the demand reaches the words that stand before it, so inverting
the demand gives the copy's training position, and a range sort by position gives the training order.

Documents are dealt out within a source by a hash of their id. Sources are counted first; equal ranges of hashes cut a
hot one into as many runs as its rows ask for, and runs are summed before anything is joined or ordered. A run that is
still too large, as one id or none at all repeats in it, is cut into pieces by a hash of id and text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, piece_of, ranked, run_count, run_of, split_runs

#: Relative weight at training times 0, 1/2 and 1, by weight class: the first kind fades, the second stays, the third grows.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
TIMES = (0.0, 0.5, 1.0)


def word_count(text: Column) -> Column:
    """Runs of other characters than ASCII blanks; null has none."""
    blanks_then_words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(blanks_then_words, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Adds weight and target: share of all words by weight, none above ``most`` times its size, the excess dealt out again.

    The level (target words per weight) is the only unknown. It rises until the sources below their cap carry the rest;
    each turn is one aggregation and brings back two sums.
    """
    if share > most:
        raise ValueError("the mix can't take more than every source's cap")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    held = cut(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most), "weights")
    total = (held.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, F.lit(False)
    while total:
        r = held.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        now = (total - r[0]) / r[1] if r[1] else level
        if now <= level:
            break
        level = now
        capped = F.col("cap") < F.col("weight") * F.lit(level)
    return held.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level))).drop("cap")


def _demand_time(x: Column, total: Column, kind: Column, schedules, times) -> Column:
    """The time at which a source with words ``total`` to give has given ``x``, weights being linear between ``times``."""

    def one(values):
        areas = [(b - a) * (u + v) / 2 for a, b, u, v in zip(times, times[1:], values, values[1:], strict=False)]
        whole = sum(areas)
        y = F.when(total > 0, x / total).otherwise(0.0) * whole  # area to cover
        out, done = F.lit(times[-1]), 0.0
        steps = []
        for a, b, u, v, area in zip(times, times[1:], values, values[1:], areas, strict=False):
            slope = (v - u) / (b - a)
            rest = F.greatest(y - done, F.lit(0.0))
            t = rest / u if slope == 0 else (F.sqrt(F.greatest(u * u + 2 * slope * rest, F.lit(0.0))) - u) / slope
            steps.append((done + area, a + t))
            done += area
        for upto, t in reversed(steps):
            out = F.when(y <= upto, t).otherwise(out)
        return F.least(out, F.lit(times[-1]))

    chosen = one(schedules[-1])
    for i in range(len(schedules) - 1):
        chosen = F.when(kind == i, one(schedules[i])).otherwise(chosen)
    return chosen


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    times: Sequence[float] = TIMES,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """One row a document: the ``carry`` columns (default: all) and size, source_size, target, taken, copies, position.

    ``taken`` counts words with repeats: within a source, documents are laid end to end in the order of their ids' MD5,
    round after round, and the mix takes the words before the target; the document there is cut. ``copies`` counts the
    copies of which something is taken and ``position`` (0 to 1) is the training time of the first; null if none is.
    Null and empty texts have size 0 and are not taken. Null sources are one source, last in order; null ids come first.
    Rows alike in id and text share their order's place in either order. A source without words has target 0. An empty
    table gives an empty one. Result columns replace input columns of the same names.
    """
    made = ("size", "source_size", "target", "taken", "copies", "position")
    keep = [c for c in (carry if carry is not None else docs.columns) if c.lower() not in made]
    placed = _placed(docs, keep, id_col, text_col, source_col, weights, share, most, schedules, times)
    return placed.select(*[F.col("row").getField(c).alias(c) for c in keep], *made[:-1], F.get("positions", F.lit(0)).alias("position"))


def _placed(docs: DataFrame, keep: Sequence[str], id_col: str, text_col: str, source_col: str, weights, share, most, schedules, times) -> DataFrame:
    """(row, size, source_size, target, taken, copies, positions): ``positions`` has the training time of each round's copy, null where nothing is taken."""
    counts = cut(docs.groupBy(col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # sources of one run are left out, so no more than MOST_RUNS are broadcast
    hot = counts.select(F.col("source").alias("hot"), run_count(F.col("n"), total).alias("runs")).where("runs > 1")
    spread = F.xxhash64(F.col("turn"), F.col("text_hash"))
    inner = docs.select(
        F.struct(*[col(c).alias(c) for c in keep]).alias("row"),
        col(source_col).alias("source"),
        F.md5(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")).alias("turn"),
        word_count(col(text_col)).alias("size"),
        F.xxhash64(col(text_col)).alias("text_hash"),
    ).join(F.broadcast(hot), F.col("source").eqNullSafe(F.col("hot")), "left")
    inner = inner.withColumn("sub", run_of(F.col("turn"), F.coalesce("runs", F.lit(1)))).drop("hot", "runs")
    runs = cut(inner.groupBy("source", "sub").agg(F.sum("size").alias("run_size"), F.count(F.lit(1)).alias("n")), "runs")
    large = split_runs(runs, ["source", "sub"])
    inner = piece_of(inner, large, ["source", "sub"], spread)
    if large is not None:
        runs = cut(inner.groupBy("source", "sub", "piece").agg(F.sum("size").alias("run_size")), "pieces")
    else:
        runs = runs.select("source", "sub", F.lit(0).alias("piece"), "run_size")
    sizes = runs.groupBy("source").agg(F.sum("run_size").alias("source_size"))
    sources = cut(with_targets(ranked(sizes, "source"), weights, share, most), "targets")
    before = F.sum("run_size").over(Window.partitionBy("source").orderBy("sub", "piece").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0)))
    named = sources.select(F.col("source").alias("s"), "source_size", "rank", "target")
    runs = runs.join(named, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("sub").alias("b"), F.col("piece").alias("p"), "before", "source_size", "rank", "target")
    placed = inner.join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("sub") == F.col("b")) & (F.col("piece") == F.col("p")))
    own = Window.partitionBy("source", "sub", "piece").orderBy("turn", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(own), F.lit(0))
    placed = placed.withColumn("start", start).withColumn("words", F.floor("target"))
    rounds = int(most) + (most > int(most))
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("start") - F.col("source_size") * k)) for k in range(rounds)]
    taken = sum(parts[1:], parts[0])
    copies = sum((F.when(p > 0, 1).otherwise(0) for p in parts[1:]), F.when(parts[0] > 0, 1).otherwise(0))
    time = lambda k: _demand_time((F.col("start") + F.col("source_size") * k).cast("double"), F.col("words").cast("double"), F.col("rank") % len(schedules), schedules, times)
    return placed.select(
        "row",
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        taken.cast("long").alias("taken"),
        copies.cast("int").alias("copies"),
        F.array(*[F.when(p > 0, time(k)) for k, p in enumerate(parts)]).alias("positions"),
    )


def training_order(mixed: DataFrame, parts: int | None = None) -> DataFrame:
    """Range-sorted by training position; documents that are not taken (null positions) come last, ties lie in the order of a hash of the row. An empty table stays one."""
    spread = F.xxhash64(F.struct(*[col(c) for c, kind in mixed.dtypes if not kind.startswith(("map", "variant"))]))  # many rows may share a position
    order = (F.col("position").asc_nulls_last(), spread)
    ranged = mixed.repartitionByRange(parts, *order) if parts else mixed.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    times: Sequence[float] = TIMES,
) -> DataFrame:
    """The documents as the mix takes them: a row for each copy, in range order of the copy's own training position, with the columns of ``docs``.

    Nulls, ties, repeated rows and an empty table are as in ``mix``; null and empty texts are not taken, so they go.
    """
    names = docs.columns
    placed = _placed(docs, names, id_col, text_col, source_col, weights, share, most, schedules, times)
    each = placed.select("row", F.explode(F.filter("positions", lambda x: x.isNotNull())).alias("position"))
    return training_order(each).select(*[F.col("row").getField(c).alias(c) for c in names])
