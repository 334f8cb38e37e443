"""Shards along a Hilbert curve, in DataFrame functions only.

Metadata dimensions are quantised to a few bits each, the cell's index on the Hilbert curve is computed from them, and
the curve is cut into runs of equal row counts. Neighbours on the curve are close in every dimension, so each shard
spans a narrow range of all of them and readers can skip files by the minima and maxima of any.

Rows are ordered by (curve index, MD5 of the id). Cells are counted first; equal ranges of MD5s cut a hot one into as
many runs as its rows ask for. A run that is still too large, as one id or none at all repeats in it, is cut into pieces by
a hash of id, text and size. Only the counts of these are summed; rows are dealt out once, by run and piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, let, piece_of, ranked, run_count, run_of, split_runs

BITS = 4


def hilbert_tables(n: int) -> tuple[list[int], list[int]]:
    """For each state and cell of the 2**n cells below a cube: its place on the curve, and its own state.

    A state is an entry corner and a direction: corner * n + direction. Cells are visited in Gray-code order, turned and
    reflected by the state.
    """
    full = (1 << n) - 1
    ror = lambda x, k: ((x >> k % n) | (x << (n - k % n))) & full
    rol = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & full
    gray = lambda i: i ^ (i >> 1)
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    entry = lambda i: gray(2 * ((i - 1) // 2)) if i else 0
    turn = lambda i: 0 if i == 0 else (ones(i - 1) if i % 2 == 0 else ones(i)) % n
    place, state = [], []
    for corner in range(1 << n):
        for d in range(n):
            for cell in range(1 << n):
                g = ror(cell ^ corner, d + 1)
                w = next(i for i in range(1 << n) if gray(i) == g)
                place.append(w)
                state.append((corner ^ rol(entry(w), d + 1)) * n + (d + turn(w) + 1) % n)
    return place, state


def hilbert_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of the point whose coordinates (0 to 2**bits - 1) are ``cells``."""
    n = len(cells)
    place, state = hilbert_tables(n)
    table = F.array(*[F.lit(p * (n << n) + s) for p, s in zip(place, state, strict=True)])  # both in one number

    def step(acc: Column, b: Column) -> Column:
        cell = F.lit(0)
        for i, c in enumerate(cells):
            cell = cell + F.call_function("shiftright", c, b).bitwiseAND(F.lit(1)) * (1 << i)
        both = F.element_at(table, (acc.getField("s") * (1 << n) + cell + 1).cast("int"))
        return F.struct((acc.getField("h") * (1 << n) + F.floor(both / (n << n))).cast("long").alias("h"), (both % (n << n)).cast("long").alias("s"))

    zero = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("s"))
    return F.aggregate(F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)]), zero, step, lambda acc: acc.getField("h"))


def cut_points(df: DataFrame, value: Column, cells: int) -> list:
    """For i from 1 to ``cells`` - 1 the value at i / ``cells`` of the way through the distinct values in order, null left out; none if there are no values."""
    values = cut(ranked(df.select(value.alias("v")).where("v is not null").distinct(), "v"), "values")
    n = values.count()
    wanted = [i * n // cells for i in range(1, cells)]
    at = {r["rank"]: r.v for r in values.where(F.col("rank").isin(wanted)).collect()} if n else {}
    return [at[r] for r in wanted] if n else []


def curve_of(df: DataFrame, dims: dict[str, Column], bits: int = BITS) -> Column:
    """Each row's place on the curve. A dimension's cell is how many of its 2**bits - 1 cut points it reaches, so that
    distinct values are spread evenly over all cells and few of them have cells of their own; null reaches none."""
    cuts = [cut_points(df, c, 1 << bits) for c in dims.values()]
    cell = lambda v, at: sum((F.when(v >= F.lit(x), 1).otherwise(0) for x in at), F.lit(0))
    cells = lambda d: F.struct(*[cell(d.getField(n), at).alias(n) for n, at in zip(dims, cuts, strict=True)])
    # each step is bound before the next uses it many times
    return let(F.struct(*[c.alias(n) for n, c in dims.items()]), lambda d: let(cells(d), lambda c: hilbert_index([c.getField(n) for n in dims], bits)))


def hilbert_shards(
    docs: DataFrame,
    shards: int,
    dims: dict[str, Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = BITS,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """The ``carry`` columns (default: all) and size, text_crc32, curve, shard, slot: rows of all shards are at most one apart.

    ``dims`` maps names to columns of any type that has an order; the default is language, source and log2 of the size.
    size is the text's UTF-8 bytes (null: none) plus 8; text_crc32 is of those bytes. slot numbers a shard's rows from 0
    along the curve. Null dimensions lie in the lowest cell; null ids come first in their cell; rows alike in id, checksum
    and size may take each other's slots. With fewer rows than shards some shards stay empty. An empty table gives an
    empty result. Result columns replace input columns of the same names.
    """
    made = ("size", "text_crc32", "curve", "shard", "slot")
    keep = [c for c in (carry if carry is not None else docs.columns) if c.lower() not in made]
    raw = F.coalesce(col(text_col), F.lit(""))
    size = F.octet_length(raw).cast("long") + 8
    dims = dims or {"lang": col("lang").cast("string"), "source": col("source").cast("string"), "size": F.floor(F.log2(size))}
    curve = curve_of(docs, dims, bits)
    turn = F.md5(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary"))
    # at most 2**(bits * dims) cells, whatever the input
    cells = cut(docs.groupBy(curve.alias("cell")).agg(F.count(F.lit(1)).alias("cell_n")), "cells")
    total = cells.agg(F.sum("cell_n")).first()[0] or 0
    many = cells.select("cell", run_count(F.col("cell_n"), total).alias("runs")).where("runs > 1")
    dealt = lambda df: df.join(F.broadcast(many), F.col("curve") == F.col("cell"), "left").withColumn("sub", run_of(F.col("turn"), F.coalesce("runs", F.lit(1)))).drop("cell", "runs")
    crc = F.crc32(raw.cast("binary"))
    spread = F.xxhash64(F.col("turn"), F.col("text_crc32"), F.col("size"))
    rows = dealt(docs.select(F.struct(*[col(c).alias(c) for c in keep]).alias("row"), size.alias("size"), crc.alias("text_crc32"), curve.alias("curve"), turn.alias("turn")))
    keys = docs.select(size.alias("size"), crc.alias("text_crc32"), curve.alias("curve"), turn.alias("turn"))
    counts = cut(dealt(keys.select("curve", "turn")).groupBy("curve", "sub").agg(F.count(F.lit(1)).alias("n")), "runs")
    large = split_runs(counts, ["curve", "sub"])
    if large is not None:
        counts = cut(piece_of(dealt(keys), large, ["curve", "sub"], spread).groupBy("curve", "sub", "piece").agg(F.count(F.lit(1)).alias("n")), "pieces")
    else:
        counts = counts.withColumn("piece", F.lit(0))
    counts = counts.select(F.col("curve").alias("c"), F.col("sub").alias("b"), F.col("piece").alias("p"), "n")
    in_cell = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("b", "p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce(F.sum("cell_n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed_cells = cells.select("cell", before.alias("cell_before"))
    runs = counts.withColumn("in_cell", in_cell).join(placed_cells, F.col("c") == F.col("cell")).select("c", "b", "p", (F.col("in_cell") + F.col("cell_before")).alias("before"))
    own = F.row_number().over(Window.partitionBy("curve", "sub", "piece").orderBy("turn", "text_crc32", "size")) - 1
    rows = piece_of(rows, large, ["curve", "sub"], spread)
    placed = rows.join(runs, (F.col("curve") == F.col("c")) & (F.col("sub") == F.col("b")) & (F.col("piece") == F.col("p"))).withColumn("rank", (F.col("before") + own).cast("long"))
    n = F.lit(max(total, 1))
    placed = placed.withColumn("shard", F.call_function("div", F.col("rank") * shards, n).cast("int"))
    first = F.call_function("div", F.col("shard") * n + (shards - 1), F.lit(shards))
    return placed.select(
        *[F.col("row").getField(c).alias(c) for c in keep], "size", "text_crc32", "curve", "shard", (F.col("rank") - first).cast("long").alias("slot")
    )


def write_shards(sharded: DataFrame, path: str, shards: int, files: int = 1) -> None:
    """One directory a shard, in it ``files`` files or so that follow each other along the curve.

    Rows are ranged by (shard, slot) into ``shards`` * ``files`` tasks of about equal counts, so a shard is written by as many
    tasks as it has files; a border of ranges may fall into a shard, which then has one more. Null, repeated and
    clashing columns are written as they are; shards without rows have no directory, and an empty table writes none.
    """
    sharded.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
