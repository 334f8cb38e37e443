"""What the training-data operators share: a shared folder for cut lineage, Arrow mapping and word tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java and DuckDB pattern of a blank run, and of a word between blanks.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(is_word: Callable[[int], bool]) -> bytes:
    lower = lambda b: b + 32 if 0x41 <= b <= 0x5A else b
    return bytes(lower(b) if is_word(b) else 0x20 for b in range(256))


#: UTF-8 byte tables for bytes.translate: A-Z lower-cased, every byte outside a word made a space.
#: Bytes from 0x80 on belong to non-ASCII characters, which count as word characters in both.
BLANK_TABLE = _table(lambda b: b not in b" \t\n\x0b\x0c\r")
ALNUM_TABLE = _table(lambda b: b >= 0x80 or chr(b).isalnum())


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, _UPPER, _LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once as a lambda variable, so that ``body`` can use it many times without its being computed again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a local master may lack that setting, as in tests; it then gets a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="sitelens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/sitelens-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts lineage with a copy that outlives executors. A join whose sides are both cut tables shuffles both, so that
    adaptive execution can split a hot key, which it cannot do over an aggregate that is already dealt out by that key.
    """
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    table = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    table.shared_folder = folder
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``cut`` made and that nothing will read again."""
    for t in tables:
        folder = getattr(t, "shared_folder", None)
        if folder:
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def task_count(spark: SparkSession, groups: int, size: int, task_bytes: int = 256 << 20) -> int:
    """Tasks for ``groups`` pieces of work of ``size`` bytes in all: a few a core while they are small, else one for ``task_bytes``."""
    return max(1, min(groups, max(4 * spark.sparkContext.defaultParallelism, -(-size // task_bytes))))


#: A key with more rows than this, or than the MOST_HOT-th part of all rows, is hot; so there are at most MOST_HOT hot keys.
HOT_ROWS, MOST_HOT = 100_000, 10_000


def join_split(rows: DataFrame, table: DataFrame, key: str, count: str, spread: Column) -> DataFrame:
    """Left join of ``rows`` with ``table`` by ``key``; ``table`` has a row a key and, in ``count``, how many rows hold it.

    Hot keys are dealt to parts by ``spread`` on the side of the rows and copied to each part in the table. Which keys
    are hot is broadcast, MOST_HOT rows at most. The key is taken from ``rows``; ``count`` is dropped.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = max(HOT_ROWS, -(-total // MOST_HOT))
    parts = F.ceil(F.col(count) / hot).cast("int")
    heavy = table.where(F.col(count) > hot).select(F.col(key).alias("__hot"), parts.alias("__parts"))
    dealt = rows.join(F.broadcast(heavy), F.col(key) == F.col("__hot"), "left").withColumn("__part", F.pmod(spread, F.coalesce("__parts", F.lit(1))).cast("int")).drop("__hot", "__parts")
    copies = table.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(count).withColumnRenamed(key, "__key")
    return dealt.join(copies, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__copy")), "left").drop("__key", "__part", "__copy")


#: Runs into which hot groups are cut have about this many rows, or the MOST_RUNS-th part of all rows if that is more.
RUN_ROWS, MOST_RUNS = 1024, 100_000


def run_count(n: Column, total: int) -> Column:
    """Runs for a group of ``n`` of ``total`` rows; at most MOST_RUNS more than there are groups."""
    return F.greatest(F.ceil(n / max(RUN_ROWS, -(-total // MOST_RUNS))), F.lit(1)).cast("long")


def run_of(turn: Column, runs: Column) -> Column:
    """The run, from 0, of a row whose hash is ``turn`` (in hex digits): equal ranges of hashes, in their order."""
    return F.shiftright(F.conv(F.substring(turn, 1, 8), 16, 10).cast("long") * runs, 32).cast("int")


def split_runs(counts: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Runs that hold far more rows than runs should, as where one id or none at all repeats: ``keys``, and ``pieces`` to cut them into.

    ``counts``: keys and ``n``. At most a quarter of MOST_RUNS of them, which may be broadcast; None if there are none.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    usual = max(RUN_ROWS, -(-total // MOST_RUNS))
    large = cut(counts.where(F.col("n") > 4 * usual).select(*keys, F.ceil(F.col("n") / usual).cast("long").alias("pieces")), "large")
    return None if large.isEmpty() else large


def piece_of(rows: DataFrame, large: DataFrame | None, keys: Sequence[str], spread: Column) -> DataFrame:
    """``rows`` with the ``piece`` of their run: a range of the hash ``spread`` in runs that ``split_runs`` found, else 0."""
    if large is None:
        return rows.withColumn("piece", F.lit(0))
    named = large.select(*[F.col(k).alias(f"__{k}") for k in keys], "pieces")
    on = F.col(keys[0]).eqNullSafe(F.col(f"__{keys[0]}"))
    for k in keys[1:]:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    part = F.pmod(spread, F.coalesce("pieces", F.lit(1))).cast("int")
    return rows.join(F.broadcast(named), on, "left").withColumn("piece", part).drop("pieces", *[f"__{k}" for k in keys])


def ranked(values: DataFrame, by: str, parts: int = 16) -> DataFrame:
    """``values`` with their ``rank`` from 0 in the order of ``by``, null last. Each task ranks a range; only the ranges' counts are summed in one place."""
    order = col(by).asc_nulls_last()
    ranged = cut(values.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("own", own).join(base, F.col("part") == F.col("p")).select(*[col(c) for c in values.columns], (F.col("own") + F.col("base")).alias("rank"))


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those called ``names`` in any case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def col(name: str) -> Column:
    """A column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def runs(text: bytes, marks: bytearray) -> list[tuple[int, int, int, int]]:
    """Runs of marked words (of ALNUM_TABLE): first and last word, and the code-point range [start, end) of the original text."""
    import numpy as np

    raw = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(text.translate(ALNUM_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
    starts, ends = at[np.flatnonzero(edge == 1)], at[np.flatnonzero(edge == -1)]
    hit = np.diff(np.concatenate(([0], np.frombuffer(marks, np.int8), [0])))
    ranges = zip(np.flatnonzero(hit == 1), np.flatnonzero(hit == -1) - 1, strict=True)
    return [(int(a), int(b), int(starts[a]), int(ends[b])) for a, b in ranges]


def annotate(
    df: DataFrame,
    make: Callable[[], Callable[[list[bytes | None]], list[tuple]]],
    result: T.StructType,
    out: str,
    text_col: str = "text",
    carry: Sequence[str] | None = None,
    chunk_bytes: int = 8 << 20,
) -> DataFrame:
    """Add the struct column ``out``, made from the UTF-8 bytes of ``text_col``, without a shuffle.

    ``make()`` runs once a task and returns a function from a list of texts to a list of result tuples. ``carry`` names
    the columns to keep (default: all). A column already called ``out`` is replaced. Texts reach the function in runs of
    about ``chunk_bytes``, so memory follows the largest text and not the batch.
    """
    kept = without(df.select([col(c) for c in carry]) if carry is not None else df, out)
    tmp = "__text_of_" + out
    src = df.select(*[col(c) for c in kept], col(text_col).cast("string").alias(tmp))
    schema = T.StructType([*src.select([col(c) for c in kept]).schema.fields, T.StructField(out, result)])
    names = [f.name for f in result.fields]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(result)
        fn = make()
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index(tmp))
            raw = raw.cast(pa.large_binary() if pa.types.is_large_string(raw.type) else pa.binary())
            rows: list[tuple] = []
            part: list[bytes | None] = []
            held = 0
            for x in raw:
                part.append(b := x.as_py())
                held += len(b or b"") + 64
                if held >= chunk_bytes:
                    rows += fn(part)
                    part, held = [], 0
            if part:
                rows += fn(part)
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            made = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(columns, kind, strict=True)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [made], names=[*kept, out])

    return src.mapInArrow(run, schema)
