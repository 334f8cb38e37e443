"""WARC archives: write records, index them first, then read selected records by coalesced byte ranges.

Each task writes archives of its own, every record a gzip member of its own, and hands back one index row a record:
archive, offset, length, URL, digest. Only the index of tasks that ended well is kept, so an archive left by a lost
executor is never read. Reading starts from any selection of index rows: their ranges are sorted and joined within
windows of an archive, each window is fetched in as few reads as its gaps allow, and records are cut out of the bytes.

Archives live in the shared folder and are reached through pyarrow's file systems (local, HDFS, S3, GCS), because Spark
has no reader of byte ranges; tables are read and written by Spark alone.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, join_split, shared_folder, task_count

ARCHIVE_BYTES = 1 << 30
WINDOW_BYTES = 8 << 20
GAP_BYTES = 64 << 10

INDEX = "archive string, offset long, length long, record_id string, url string, payload_digest string, record_type string"
RECORD = "record_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary, archive string, offset long, length long"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _digest(payload: bytes) -> str:
    from base64 import b32encode
    from hashlib import sha1

    return b32encode(sha1(payload).digest()).decode()


def record_bytes(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> tuple[bytes, str]:
    """(one WARC/1.1 record, digest). With ``refers_to`` it is a revisit without payload. Line ends in a URL become spaces."""
    digest = _digest(payload)
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.splitlines()))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append(f"X-Payload-Length: {len(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
        payload = b""
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(payload)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + payload + b"\r\n\r\n", digest


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    return fields, rest[: int(fields.get("content-length", 0))]


def originals(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """``pages`` with ``__original``: the largest id among rows of equal payload.

    Digests are counted first, combined before they are shuffled. Only those that repeat are joined back, and hot ones,
    which may hold any share of the rows, in parts.
    """
    payload = F.coalesce(col(payload_col).cast("binary"), F.lit(b""))
    keyed = pages.withColumn("__digest", F.sha2(payload, 256))
    whole = keyed.groupBy("__digest").agg(F.max(col(id_col)).alias("__max"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    both = join_split(keyed, cut(whole.withColumn("__twice", F.lit(True)), "repeated"), "__digest", "__n", F.xxhash64(col(id_col)))
    return both.withColumn("__original", F.when(F.col("__twice"), F.col("__max")).otherwise(col(id_col))).drop("__digest", "__max", "__twice")


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write one record a row and return the index (INDEX columns).

    Of rows with equal payloads (empty ones too; null counts as empty) the one with the largest id is a response, the
    others are revisits that refer to it. Rows that repeat that id are responses too. A row without an id refers to the
    group's largest id, and is a response if the group has none. Null URLs have no target field. An empty table gives
    an empty index. Other columns are not read.
    """
    folder = folder or shared_folder(pages.sparkSession) + "/warc"
    rows = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), F.coalesce(col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = originals(rows, "id", "payload").select(F.coalesce(F.col("id").cast("string"), F.lit("none")).alias("id"), "url", "payload",
        F.when(F.col("id").eqNullSafe(F.col("__original")), None).otherwise(F.col("__original").cast("string")).alias("refers"))

    def run(batches) -> Iterator:
        import uuid
        from zlib import compressobj

        import pyarrow as pa

        system, root = _fs(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, None, 0
        for batch in batches:
            made = []
            for record_id, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                raw, digest = record_bytes(record_id, url, payload, refers)
                gz = compressobj(6, wbits=31)
                member = gz.compress(raw) + gz.flush()
                out.write(member)
                made.append((f"{folder}/{name}", at, len(member), record_id, url, digest, "response" if refers is None else "revisit"))
                at += len(member)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4], strict=True)],
                    names=["archive", "offset", "length", "record_id", "url", "payload_digest", "record_type"])
        if out is not None:
            out.close()

    return cut(rows.mapInArrow(run, INDEX), "index")


def coalesced(ranges: list[tuple[int, int]], gap: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(begin, end, ranges) of reads that cover sorted (offset, length) ranges, joined over gaps of at most ``gap`` bytes."""
    out: list[list] = []
    for offset, length in sorted(ranges):
        if out and offset - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], offset + length)
            out[-1][2].append((offset, length))
        else:
            out.append([offset, offset + length, [(offset, length)]])
    return [(begin, end, held) for begin, end, held in out]


def read_warc(selected: DataFrame, window_bytes: int = WINDOW_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """Records (RECORD columns) of the index rows in ``selected`` (archive, offset, length).

    Ranges are grouped by windows of ``window_bytes`` of an archive, so a group is bounded by its bytes; the bytes to read
    set the number of tasks. A range named twice is read once and returned once. No selected rows give no records.
    Records without URL or refers-to field have nulls there; ids and URLs come back as strings. A response whose payload
    does not match its digest raises an error.
    """
    window = F.floor(F.col("offset") / window_bytes)
    work = selected.agg(F.count_distinct("archive", window), F.sum("length")).first()
    tasks = task_count(selected.sparkSession, work[0], work[1] or 0)
    reads = selected.groupBy("archive", window.alias("window")).agg(F.sort_array(F.collect_set(F.struct("offset", "length"))).alias("ranges"))

    def run(batches) -> Iterator:
        from zlib import decompress

        import pyarrow as pa

        for batch in batches:
            for archive, ranges in zip(batch.column("archive"), batch.column("ranges"), strict=True):
                uri = archive.as_py()
                system, path = _fs(uri)
                with system.open_input_file(path) as f:
                    for begin, end, held in coalesced([(r["offset"], r["length"]) for r in ranges.as_py()], gap_bytes):
                        f.seek(begin)
                        raw = f.read(end - begin)
                        made = []
                        for offset, length in held:
                            h, block = parse_record(decompress(raw[offset - begin : offset - begin + length], wbits=31))
                            digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
                            if kind == "response" and _digest(block) != digest:
                                raise ValueError(f"digest of the record at {offset} of {uri} differs")
                            bare = lambda k, h=h: h[k][len("<urn:record:") : -1] if k in h else None
                            made.append((bare("warc-record-id"), h.get("warc-target-uri"), kind, digest, int(h["x-payload-length"]), bare("warc-refers-to"), block, uri, offset, length))
                        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
                        names = [x.split()[0] for x in RECORD.split(", ")]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    return reads.select("archive", "ranges").repartition(tasks).mapInArrow(run, RECORD)
