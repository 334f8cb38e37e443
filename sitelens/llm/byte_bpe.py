"""Byte-level BPE by recursive DuckDB queries inside each partition.

Encoding: a text falls into words by the vocabulary's pattern. Each distinct word is a run of token-position rows, at
first one a byte. A recursive query joins neighbouring rows with the merge table, contracts each word's leftmost pair of
minimum rank, and goes on until no word has a pair. Decoding joins ids with the vocabulary and aggregates them in order.

Spark deals out the texts; the database of a task lives in memory, on one thread, and sees bounded legs of rows.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, col
from .pieces import Memory, cut_pieces, gather

#: Words of more bytes are cut where no token can lie across, and contracted at every place of the least rank at once.
LONG_WORD = 64
#: Bytes of words in one query, tokens in one decoding query, and rows that the turns of one query over long words leave.
LEG_BYTES, LEG_TOKENS, LEG_ROWS = 400_000, 200_000, 2_000_000
#: Bytes of texts that are encoded together.
CHUNK_BYTES = 2 << 20
#: Distinct pieces whose ids a worker remembers, some 200 bytes each.
MOST_PIECES = 800_000

ENCODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

#: Words of at most LONG_WORD bytes: one pair a turn.
_SHORT = """
WITH RECURSIVE state(w, place, id, done) AS (
  SELECT w, place, id, false FROM rows_in
  UNION ALL
  (WITH live AS MATERIALIZED (SELECT w::BIGINT << 32 | place AS k, w, place, id FROM state WHERE NOT done),
    least AS (
      SELECT x.w AS own, min(m.rank::BIGINT << 32 | x.place) AS low
      FROM live x JOIN live y ON y.k = x.k + 1 JOIN merges m ON m.a = x.id AND m.b = y.id GROUP BY x.w)
  SELECT w, CASE WHEN place > (low & 4294967295) THEN place - 1 ELSE place END,
    CASE WHEN place = (low & 4294967295) THEN (low >> 32)::INT ELSE id END, low IS NULL
  FROM live LEFT JOIN least ON w = own WHERE low IS NULL OR place <> (low & 4294967295) + 1)
)
SELECT w, id FROM state WHERE done ORDER BY w, place
"""

#: Long words: every pair of the least rank a turn, from the left, none overlapping the one before.
_LONG = """
WITH RECURSIVE state(turn, w, place, id, done) AS (
  SELECT 0, w, place, id, false FROM rows_in
  UNION ALL
  SELECT turn + 1, w, place, CASE WHEN taken THEN rank ELSE id END, low IS NULL FROM (
    SELECT *, coalesce(lag(taken) OVER along, false) AS gone FROM (
      SELECT *, coalesce(rank = low AND (nth - coalesce(max(CASE WHEN rank = low THEN NULL ELSE nth END) OVER along, 0)) % 2 = 1, false) AS taken FROM (
        SELECT *, min(rank) OVER (PARTITION BY w) AS low FROM (
          SELECT turn, w, place, id, nth, m.rank FROM (
            SELECT *, lead(id) OVER along AS after, row_number() OVER along AS nth FROM state WHERE NOT done AND turn < $turns
            WINDOW along AS (PARTITION BY w ORDER BY place)) LEFT JOIN merges m ON a = id AND b = after))
      WINDOW along AS (PARTITION BY w ORDER BY place))
    WINDOW along AS (PARTITION BY w ORDER BY place))
  WHERE NOT gone
)
SELECT w, place, id, done FROM state WHERE done OR turn = $turns ORDER BY w, place
"""

_DECODE = "SELECT owner, unhex(string_agg(hex, '' ORDER BY place)) FROM rows_in JOIN vocab USING (id) GROUP BY owner ORDER BY owner"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks, which are their ids, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Database:
    """A task's database in memory; ``rows_in`` names the rows a query reads."""

    def __init__(self):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1})

    def _run(self, sql: str, rows, **values):
        self.db.register("rows_in", rows)
        return self.db.execute(sql, values or None)


class Speller(Database):
    """The vocabulary's bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        import pyarrow as pa

        super().__init__()
        rows = pa.table([pa.array(list(ranks.values()), pa.int32()), pa.array([t.hex() for t in ranks])], names=["id", "hex"])
        self._run("CREATE TABLE vocab AS SELECT * FROM rows_in", rows)

    def decode(self, ids: Sequence):
        """The bytes of each array of ids, by ordered aggregation."""
        import numpy as np
        import pyarrow as pa

        n = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *ids])
        owner = np.repeat(np.arange(len(ids)), n)
        out: list[list[bytes]] = [[] for _ in ids]
        for at in range(0, len(flat), LEG_TOKENS):
            leg = slice(at, at + LEG_TOKENS)
            place = np.arange(len(flat[leg]))
            for i, raw in self._run(_DECODE, pa.table([owner[leg], place, flat[leg]], names=["owner", "place", "id"])).fetchall():
                out[i].append(raw)
        return [b"".join(x) for x in out]


class Merger(Database):
    """The vocabulary's merge table and the queries that contract words by it."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np
        import pyarrow as pa

        super().__init__()
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        ints = lambda v: pa.array(v, pa.int32())
        self._run("CREATE TABLE merges AS SELECT * FROM rows_in", pa.table([ints([p[i] for p in pairs]) for i in range(3)], names=["a", "b", "rank"]))
        joint = np.zeros((256, 256), dtype=bool)
        for t in ranks:
            both = np.frombuffer(t, np.uint8)
            joint[both[:-1], both[1:]] = True
        self.joint = joint

    def _rows(self, words: Sequence[bytes]):
        import numpy as np
        import pyarrow as pa

        n = np.array([len(w) for w in words])
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        return pa.table([np.repeat(np.arange(len(words), dtype=np.int32), n), place.astype(np.int32), ids], names=["w", "place", "id"])

    def _short(self, words: Sequence[bytes]):
        import numpy as np

        counts, ids, at = [], [], 0
        while at < len(words):
            held, end = 0, at
            while end < len(words) and (held == 0 or held + len(words[end]) <= LEG_BYTES):
                held, end = held + len(words[end]), end + 1
            got = self._run(_SHORT, self._rows(words[at:end])).fetchnumpy()
            counts.append(np.bincount(got["w"], minlength=end - at))
            ids.append(np.asarray(got["id"], dtype=np.int32))
            at = end
        return (np.concatenate(counts), np.concatenate(ids)) if counts else (np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _long(self, word: bytes):
        """Ids of one long word. What its turns leave is bounded: after so many turns the rest starts anew."""
        import numpy as np
        import pyarrow as pa

        rows = self._rows([word])
        while True:
            turns = max(1, LEG_ROWS // rows.num_rows)
            got = self._run(_LONG, rows, turns=turns).fetchnumpy()
            ids = np.asarray(got["id"], dtype=np.int32)
            if not len(ids) or got["done"].all():
                return ids
            rows = pa.table([np.zeros(len(ids), np.int32), np.arange(len(ids), dtype=np.int32), ids], names=["w", "place", "id"])

    def contract(self, words: Sequence[bytes]):
        """(tokens of each word, their ids): words that are tokens are their own; others are contracted."""
        import numpy as np

        whole = [self.ranks.get(w) for w in words]
        parts: list[bytes] = []
        spans = []
        for w, known in zip(words, whole, strict=True):
            if known is not None:
                spans.append(0)
            elif len(w) <= LONG_WORD:
                parts.append(w)
                spans.append(1)
            else:
                raw = np.frombuffer(w, np.uint8)
                at = [0, *(np.flatnonzero(~self.joint[raw[:-1], raw[1:]]) + 1).tolist(), len(w)]
                parts += [w[a:b] for a, b in zip(at, at[1:], strict=False)]
                spans.append(len(at) - 1)
        fresh: dict[bytes, int] = {}
        order = np.array([fresh.setdefault(p, len(fresh)) for p in parts], dtype=np.int64)
        names = list(fresh)
        short = [i for i, p in enumerate(names) if len(p) <= LONG_WORD]
        counts = np.zeros(len(names), np.int64)
        n, ids = self._short([names[i] for i in short])
        counts[short] = n
        starts = np.zeros(len(names), np.int64)
        starts[short] = np.cumsum(n) - n
        flat = [ids]
        for i, p in enumerate(names):
            if len(p) > LONG_WORD:
                own = self._long(p)
                starts[i], counts[i] = sum(map(len, flat)), len(own)
                flat.append(own)
        index, n_part = gather(starts, counts, order)
        known = np.array([-1 if k is None else k for k in whole], dtype=np.int32)
        span = np.array(spans, dtype=np.int64)
        upto = np.concatenate(([0], np.cumsum(n_part)))[np.concatenate(([0], np.cumsum(span)))]
        n_word = np.where(known >= 0, 1, np.diff(upto))
        out = np.repeat(known, n_word)
        out[np.repeat(known < 0, n_word)] = np.concatenate(flat)[index]
        return n_word, out


@lru_cache(maxsize=4)
def check_vocabulary(data: bytes) -> bool:
    """True if every token is what its own bytes contract to, as in any vocabulary learned by merging pairs.

    Then a contraction never makes a pair of lower rank than its own: such a pair would be a token whose bytes had not
    been contracted to it before. So all places of the least rank may be contracted at once.
    """
    ranks = read_ranks(data)
    merger = Merger(ranks)
    n, ids = merger._short([t for t in ranks if len(t) <= LONG_WORD])
    longer = [t for t in ranks if len(t) > LONG_WORD]
    return bool((n == 1).all()) and ids.tolist() == [r for t, r in ranks.items() if len(t) <= LONG_WORD] and all(merger._long(t).tolist() == [ranks[t]] for t in longer)


@lru_cache(maxsize=1)
def _encoder(data: bytes, pattern: str) -> Memory:
    """Kept between the tasks of a worker."""
    import numpy as np
    import regex

    merger, split = Merger(read_ranks(data)), regex.compile(pattern)

    def encode(pieces: list[str]):
        at: dict[str, int] = {}
        words = [[at.setdefault(w, len(at)) for w in split.findall(p)] for p in pieces]
        counts, ids = merger.contract([w.encode() for w in at])
        starts = np.cumsum(counts) - counts
        index, n = gather(starts, counts, np.array([w for own in words for w in own], dtype=np.int64))
        ends = np.cumsum([len(own) for own in words], dtype=np.int64)
        upto = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], ends))]
        return [(np.diff(upto), ids[index])]

    return Memory(encode, most=MOST_PIECES)


@lru_cache(maxsize=1)
def _speller(data: bytes) -> Speller:
    return Speller(read_ranks(data))


def bpe_encode(docs: DataFrame, tokenizer: str, pattern: str, text_col: str = "text", out: str = "tokens", carry: Sequence[str] | None = None, decode: bool = False) -> DataFrame:
    """``docs`` with the struct ``out``: n_tokens and ids, little-endian unsigned 32-bit integers, without special tokens; with
    ``decode`` also decoded, the bytes of those ids as ``bpe_decode`` finds them, which saves a second pass of the rows.

    ``tokenizer`` names a rank file, read on the driver and broadcast (about one MB); ``pattern`` splits texts into
    words, its blanks being those of Unicode. Null and empty texts have no tokens. Texts are encoded whole; words longer
    than LONG_WORD bytes are contracted to the same ids in fewer turns. Repeated rows are encoded alike; an empty table
    stays one. A column called ``out`` is replaced.
    """
    with open(tokenizer, "rb") as f:
        data = f.read()
    if not check_vocabulary(data):
        raise ValueError("not a vocabulary that was learned by merging pairs")
    held = docs.sparkSession.sparkContext.broadcast(data)
    words_of = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")

    def make():
        import numpy as np

        memory = _encoder(held.value, words_of)
        speller = _speller(held.value) if decode else None

        def run(texts):
            ids, n = memory.look_up([cut_pieces((t or b"").decode()) for t in texts])[0]
            ends = np.cumsum(n)
            raw = ids.astype("<u4").tobytes()
            rows = [(int(k), raw[4 * (e - k) : 4 * e]) for k, e in zip(n.tolist(), ends.tolist(), strict=True)]
            return [(*r, d) for r, d in zip(rows, speller.decode(np.split(ids, ends[:-1])), strict=True)] if decode else rows

        return run

    result = T.StructType([*ENCODED.fields, T.StructField("decoded", T.BinaryType())]) if decode else ENCODED
    return annotate(docs, make, result, out, text_col, carry, chunk_bytes=CHUNK_BYTES)


def bpe_decode(encoded: DataFrame, tokenizer: str, ids: str = "tokens.ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the binary column ``out``: the bytes of the ids in ``ids`` (as ``bpe_encode`` writes them).

    Null ids give null, no ids no bytes. An id that the vocabulary lacks has no bytes. Bytes need not be whole
    characters. A column called ``out`` is replaced.
    """
    with open(tokenizer, "rb") as f:
        held = encoded.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in encoded.columns if c.lower() != out.lower()]
    src = encoded.select(*[col(c) for c in keep], F.col(ids).cast("binary").alias("__ids"))
    schema = T.StructType([*src.drop("__ids").schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        speller = _speller(held.value)
        for batch in batches:
            raw = batch.column(len(keep))
            made = speller.decode([np.frombuffer(x.as_py() or b"", "<u4") for x in raw])
            texts = pa.array([m if ok else None for ok, m in zip(raw.is_valid().to_pylist(), made, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], texts], names=[*keep, out])

    return src.mapInArrow(run, schema)
