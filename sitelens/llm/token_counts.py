"""Token counts by a separator scan of flat, unindexed token files.

Documents are tokenised into flat files of 16-bit ids, an end-of-document id after each. Counting knows nothing of their
boundaries: files are cut into blocks of equal bytes, each block is searched for separators with one vector comparison,
and boundaries are stitched across blocks by a prefix scan over (separators, last separator) of each block. The scan
runs in two levels, over runs of blocks and within them, so no task sees more than a run.

Files live in the shared folder and are reached through pyarrow's file systems (local, HDFS, S3, GCS), because Spark has
no reader of byte ranges; tables are read and written by Spark alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, cut, shared_folder, task_count

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits text before merges; the pattern belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_BYTES = 4 << 20
RUN_BLOCKS = 1024
FILE_BYTES = 1 << 30
WIDTH = 2
#: Runs of the pattern's \\s this long are cut out, as the tokenizer's pattern engine overflows on very long ones.
LONG_BLANK = 4096
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"(?<![{_SPACE}])[{_SPACE}]{{{LONG_BLANK},}}")


def vocabulary(path: str) -> bytes:
    """The vocabulary file, read on the driver and shipped with the job, so that executors need no copy of it."""
    with open(path, "rb") as f:
        return f.read()


def load_encoding(data: bytes):
    """(tokenizer, end-of-document id) of a vocabulary. The id follows the vocabulary's, so no text yields it."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
    eod = max(ranks.values()) + 1
    if eod >= 1 << 8 * WIDTH:
        raise ValueError("the vocabulary does not fit the token files' width")
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), eod


def token_ids(enc, text: str) -> list[int]:
    """The ids of ``text``. The pattern takes a blank run before other characters as one piece but for its last blank,
    and a run at the end whole; long runs are cut there and merged as one piece."""
    ids, at = [], 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += enc.encode_ordinary(text[at : run.start()])
        ids += enc._encode_single_piece(text[run.start() : end])
        at = end
    return ids + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, folder: str | None = None) -> tuple[DataFrame, int]:
    """(manifest, end-of-document id). The manifest has a row a document: file, ordinal within it, doc_id.

    Null and empty texts are documents without tokens. Files of tasks that failed have no manifest rows and are not read.
    """
    folder = folder or shared_folder(docs.sparkSession) + "/tokens"
    data = vocabulary(tokenizer)
    eod = load_encoding(data)[1]
    held = docs.sparkSession.sparkContext.broadcast(data)
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    schema = rows.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("ordinal"), "doc_id").schema

    def run(batches) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        enc, eod = load_encoding(held.value)
        out, name, at, n = None, None, 0, 0
        for batch in batches:
            files, ordinals = [], []
            for text in batch.column("text"):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at, n = f"{folder}/{uuid.uuid4().hex}.u16", 0, 0
                    out = system.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None)
                ids = np.array([*token_ids(enc, text.as_py() or ""), eod], dtype="<u2").tobytes()
                out.write(ids)
                files.append(name)
                ordinals.append(n)
                at, n = at + len(ids), n + 1
            if files:
                yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(ordinals, pa.int64()), batch.column("doc_id")], names=["file", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    return cut(rows.mapInArrow(run, schema), "manifest"), eod


def separator_scan(spark: SparkSession, files: DataFrame, eod: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in flat token ``files`` (one column, file: distinct URIs).

    A last document without a separator counts if it has tokens; a file's trailing odd byte is ignored. Empty files have
    no documents.
    """
    block_bytes -= block_bytes % WIDTH

    def blocks(batches) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column("file"):
                system, path = fs.FileSystem.from_uri(uri.as_py())
                size = system.get_file_info(path).size
                n = -(-size // block_bytes)
                for a in range(0, n, 10_000):
                    at = range(a, min(n, a + 10_000))
                    yield pa.RecordBatch.from_arrays([pa.array([uri.as_py()] * len(at)), pa.array(at, pa.int64()), pa.array([b == n - 1 for b in at])], names=["file", "block", "last"])

    def scan(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        names = ["file", "block", "last", "base", "size", "ends"]
        for batch in batches:
            for uri, block, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as f:
                    f.seek(block * block_bytes)
                    raw = f.read(block_bytes)
                tokens = np.frombuffer(raw, dtype="<u2", count=len(raw) // WIDTH)
                base = block * (block_bytes // WIDTH)
                ends = np.flatnonzero(tokens == eod) + base
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((uri, block, last, base, len(tokens), ends.tolist()), (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=names)

    listed = cut(files.mapInArrow(blocks, "file string, block long, last boolean"), "listed")
    n_blocks = listed.count()
    spread = listed.repartition(task_count(spark, n_blocks, n_blocks * block_bytes))
    found = cut(spread.mapInArrow(scan, "file string, block long, last boolean, base long, size long, ends array<long>"), "blocks")
    found = found.withColumn("run", F.floor(F.col("block") / RUN_BLOCKS))
    # prefix scan: separators before, and the last one before; first over runs of blocks, then within a run
    n, top = F.size("ends"), F.element_at("ends", -1)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = found.groupBy("file", "run").agg(F.sum(n).alias("rn"), F.max(F.when(n > 0, top)).alias("rt"))
    over = before(Window.partitionBy("file").orderBy("run"))
    runs = runs.select("file", "run", F.coalesce(F.sum("rn").over(over), F.lit(0)).alias("n0"), F.coalesce(F.max("rt").over(over), F.lit(-1)).alias("t0"))
    inner = before(Window.partitionBy("file", "run").orderBy("block"))
    placed = found.join(runs, ["file", "run"]).select(
        "file", "last", "base", "size", "ends",
        (F.col("n0") + F.coalesce(F.sum(n).over(inner), F.lit(0))).alias("first"),
        F.greatest("t0", F.coalesce(F.max(F.when(n > 0, top)).over(inner), F.lit(-1))).alias("carry"),
    )
    # the tail of the last block is a document of its own if tokens follow the last separator
    stop = F.col("base") + F.col("size")
    open_ = F.col("last") & (stop - 1 > F.when(n > 0, top).otherwise(F.col("carry")))
    placed = placed.withColumn("ends", F.when(open_, F.concat("ends", F.array(stop))).otherwise(F.col("ends")))
    gaps = F.transform("ends", lambda e, i: F.struct(i.alias("i"), (e - F.when(i == 0, F.col("carry")).otherwise(F.get("ends", i - 1)) - 1).alias("n")))
    each = placed.select("file", "first", F.explode(gaps).alias("d"))
    return each.select("file", (F.col("first") + F.col("d.i")).cast("long").alias("ordinal"), F.col("d.n").cast("long").alias("n_tokens"))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens) a document row: tokenise to flat files, scan them for separators, join the manifest.

    Null and empty texts have 0 tokens. Repeated rows are separate documents; null ids stay null. An empty table gives
    an empty result. Other columns are not read. Texts are tokenised whole, however long a word or a run of blanks is.
    The vocabulary file is read on the driver and broadcast (one MB or so).
    """
    manifest, eod = write_token_files(docs, id_col, text_col, tokenizer)
    counted = separator_scan(docs.sparkSession, manifest.select("file").distinct(), eod, block_bytes)
    return manifest.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
