"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

A cut is a byte offset where a token of either tokenizer ends. An interval of tokens whose borders are cuts is searched
from its middle outwards, by bisecting the other tokenizer's ends, for a cut inside; it is split there and both halves
are searched in turn. Intervals without a cut inside are the groups. All open intervals of a block of texts take each
step together, as arrays.

How often two ids end together is counted over the whole corpus: blocks carry a dictionary of their own pairs with
counts, the dictionaries are summed by pair and sent back to their blocks, which is less than a row a link by far.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, col, cut, join_split, without
from .pieces import Memory, cut_pieces

#: Bytes of text in one block; a task takes some hundred times as much memory.
BLOCK_BYTES = 1 << 20

_PAIRS = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())]))
ALIGNED = T.StructType(
    [
        *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")],
        T.StructField("groups", T.StringType()),
        T.StructField("links", T.BinaryType()),
        T.StructField("block", T.LongType()),
        T.StructField("pairs", _PAIRS),
    ]
)


def byte_level_tokens(vocabulary: dict[str, int]) -> list[bytes]:
    """Token bytes by id of a byte-level vocabulary, in which printable bytes stand for themselves and others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


def piece_tokens(pieces: Sequence[str]) -> list[bytes]:
    """Token bytes by id of sentence pieces: U+2581 is a blank, <0xHH> a byte."""
    import re

    byte = re.compile(r"<0x([0-9A-Fa-f]{2})>")
    return [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]


class Tokenizers:
    """Both tokenizers, fed with the pieces of blank + text; ``tokens`` has the bytes of their ids."""

    def __init__(self, a: bytes, b: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.tokens = (byte_level_tokens(self.a.get_vocab(with_added_tokens=True)), piece_tokens(pieces))
        if not all(map(all, self.tokens)) or any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("every token must have bytes, and none may go on after a blank")

    def encode(self, pieces: list[str]):
        """For A and for B (tokens of each piece, their ids); then one entry for each piece that one of them does not give back."""
        import numpy as np

        both = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)], self.b.encode([p[1:] for p in pieces], num_threads=1)
        raws = [p.encode() for p in pieces]
        lost = np.zeros(len(pieces), dtype=np.int64)
        for tokens, ids in zip(self.tokens, both, strict=True):
            lost |= np.fromiter((b"".join(map(tokens.__getitem__, own)) != raw for own, raw in zip(ids, raws, strict=True)), dtype=np.int64, count=len(raws))
        return [*[([len(x) for x in ids], np.fromiter(chain.from_iterable(ids), np.int32)) for ids in both], (lost, np.zeros(lost.sum(), np.int32))]


def shared_cuts(a_ends, b_ends, first, last):
    """Ends of the groups, as sorted indexes into ``a_ends``. Texts are the runs ``first``[i] to ``last``[i] (exclusive) of
    tokens A; the last ends of each are a cut. Both arrays of ends rise from text to text."""
    import numpy as np

    found: list = []
    lo, hi = np.asarray(first), np.asarray(last)
    while len(lo):
        middle = (lo + hi - 1) // 2
        at = np.full(len(lo), -1)
        pending, step = np.flatnonzero(hi - lo > 1), 0
        while len(pending):
            for probe in (middle[pending] - step, middle[pending] + step):
                inside = (probe >= lo[pending]) & (probe < hi[pending] - 1) & (at[pending] < 0)
                own, probe = pending[inside], probe[inside]
                there = b_ends[np.searchsorted(b_ends, a_ends[probe])] == a_ends[probe]  # never past the end: the last end is a cut
                at[own[there]] = probe[there]
            step += 1
            pending = pending[(at[pending] < 0) & ((middle[pending] - step >= lo[pending]) | (middle[pending] + step < hi[pending] - 1))]
        found.append(hi[at < 0] - 1)
        split = at >= 0
        lo, hi = np.concatenate((lo[split], at[split] + 1)), np.concatenate((at[split] + 1, hi[split]))
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


@lru_cache(maxsize=1)
def _tokenizers(a: bytes, b: bytes) -> tuple[Tokenizers, Memory]:
    """Kept between the tasks of a worker."""
    both = Tokenizers(a, b)
    return both, Memory(both.encode)


def _aligner(tokenizers: Tokenizers, memory: Memory) -> Callable:
    """A function from a block of texts to their results; the first text's has the block's dictionary of pairs."""
    import uuid

    import numpy as np

    tokens = tokenizers.tokens
    lengths = [np.array([len(t) for t in own], dtype=np.int64) for own in tokens]
    shift = max(map(len, tokens))
    marked = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";", b"") for i in range(shift)]

    def spans(n):
        ends = np.cumsum(n)
        return ends - n, ends

    def run(texts):
        raws = [b" " + t if t else b"" for t in texts]
        (a, n_a), (b, n_b), (_, lost) = memory.look_up([cut_pieces(r.decode()) if r else [] for r in raws])
        whole = lost == 0
        if not whole.all():
            a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
            n_a, n_b = n_a * whole, n_b * whole
        (fa, la), (fb, lb) = spans(n_a), spans(n_b)
        a_ends, b_ends = np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b])
        ends = shared_cuts(a_ends, b_ends, fa[n_a > 0], la[n_a > 0])
        mates = np.searchsorted(b_ends, a_ends[ends])
        # each group's A tokens, then its B tokens; the mark after a token says what follows
        size_a, size_b = np.diff(ends, prepend=-1), np.diff(mates, prepend=-1)
        group_a, group_b = np.repeat(np.arange(len(ends)), size_a), np.repeat(np.arange(len(ends)), size_b)
        order = np.zeros(len(a) + len(b), dtype=np.int64)
        before_a, before_b = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        kind_a, kind_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        kind_a[ends], kind_b[mates] = 1, 2
        kind_b[lb[n_b > 0] - 1] = 3
        order[np.arange(len(a)) + before_a[group_a]] = a + shift * kind_a
        order[np.arange(len(b)) + before_b[group_b]] = b + shift * kind_b
        # links: the tokens that end at a cut
        code = (a[ends].astype(np.int64) << 32) | b[mates]
        pairs, link, n = np.unique(code, return_inverse=True, return_counts=True)
        rank = np.argsort(-n, kind="stable")  # frequent pairs have small numbers, which compress well
        number = np.empty(len(rank), dtype="<u4")
        number[rank] = np.arange(len(rank))
        raw = number[link].tobytes()
        upto = np.searchsorted(ends, la)  # groups before each text's end
        start = np.concatenate(([0], upto[:-1]))
        block = uuid.uuid4().int >> 65
        held = [{"pair": int(p), "n": int(k)} for p, k in zip(pairs[rank].tolist(), n[rank].tolist(), strict=True)]
        out = []
        for i in range(len(texts)):
            groups = b"".join(map(marked.__getitem__, order[fa[i] + fb[i] : la[i] + lb[i]].tolist())).decode()
            k = int(upto[i] - start[i])
            out.append((int(n_a[i]), int(n_b[i]), k, k, groups, raw[4 * start[i] : 4 * upto[i]], block, held if i == 0 else None))
        return out

    return run


def align(docs: DataFrame, a_file: str, b_file: str, text_col: str = "text", out: str = "alignment", carry: Sequence[str] | None = None, groups: Callable[[Column], Column] | None = None) -> DataFrame:
    """``docs`` with the struct ``out``: n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``a_file`` is a byte-level BPE of the ``tokenizers`` library, ``b_file`` a sentence-piece model; both are read on the
    driver and broadcast (3 MB). A sees blank + text, B the text, to which it adds the blank; special tokens' strings are
    plain text. Groups are the shortest runs of tokens of both that cover the same bytes, written
    ``a1,a2|b1;a3|b2,b3``; a link is a pair of tokens that end together. A pair's count is the number of links of the
    corpus with its ids; n_best counts a text's links whose count is the highest of their B id (ties included), and
    count_sum sums the counts of its links. ``groups`` replaces the text of groups by an expression of it, which saves
    carrying it on (a digest, for one).

    Null and empty texts, and those that one of the tokenizers does not give back byte by byte (a text with U+2581), have
    no tokens: zeros and ''. Repeated rows are aligned each and all count. Texts are taken whole; they are encoded in pieces at blanks that
    start a token in both. An empty table gives an empty one. A column called ``out`` is replaced.
    """
    spark = docs.sparkSession
    data = []
    for path in (a_file, b_file):
        with open(path, "rb") as f:
            data.append(f.read())
    held = spark.sparkContext.broadcast(tuple(data))

    def make():
        return _aligner(*_tokenizers(*held.value))

    names = without(docs.select([col(c) for c in carry]) if carry is not None else docs, out)
    made = annotate(docs, make, ALIGNED, "__aligned", text_col, names, chunk_bytes=BLOCK_BYTES)
    x = F.col("__aligned")
    text = x.getField("groups")
    kept = F.struct(*[x.getField(n).alias(n) for n in ("n_a", "n_b", "n_groups", "n_links")], (groups(text) if groups else text).alias("groups"))
    rows = cut(made.select(F.struct(*[col(c).alias(c) for c in names]).alias("row"), kept.alias("kept"), x.getField("links").alias("links"), x.getField("block").alias("block"), x.getField("pairs").alias("pairs")), "aligned")

    each = rows.where("pairs is not null").select("block", F.posexplode("pairs").alias("number", "p")).select("block", "number", F.col("p.pair").alias("pair"), F.col("p.n").alias("n"))
    counts = cut(each.groupBy("pair").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("blocks")), "counts")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    best = counts.groupBy(b_id.alias("b")).agg(F.max("total").alias("most"))  # a row a B id
    judged = cut(counts.join(best, b_id == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"), "blocks"), "judged")
    known = join_split(each.drop("n"), judged, "pair", "blocks", F.xxhash64("block")).select(F.col("block").alias("home"), "number", "total", "best")

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("kept", rows.schema["kept"].dataType), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def score(texts, pairs):
        import numpy as np
        import pyarrow as pa

        number = pairs.column("number").to_numpy()
        total, is_best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        total[number], is_best[number] = pairs.column("total").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        sums = []
        for raw in texts.column("links"):
            links = np.frombuffer(raw.as_py(), "<u4")
            sums.append((int(is_best[links].sum()), int(total[links].sum())))
        both = [pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)]
        return pa.table([texts.column("row"), texts.column("kept"), *both], names=["row", "kept", "n_best", "count_sum"])

    scored = rows.drop("pairs").groupBy("block").cogroup(known.groupBy("home")).applyInArrow(score, schema)
    k = F.col("kept")
    result = F.struct(*[k.getField(n).alias(n) for n in ("n_a", "n_b", "n_groups", "n_links")], "n_best", "count_sum", k.getField("groups").alias("groups"))
    return scored.select(*[F.col("row").getField(c).alias(c) for c in names], result.alias(out))
