"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, run once over every text.

The automaton's alphabet is the benchmark's words, not its characters: a text becomes the sequence of its words' ids
(0 for a word no item has), so that a match ends at a word index and the scan takes one step a word. Word indexes map
back to code-point offsets of the original text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_TABLE, annotate, col, cut, discard, lower_ascii, runs

WINDOW = 10
#: Bytes of benchmark text in one automaton. A larger benchmark is taken in blocks of items, one after the other against
#: CHUNK_BYTES of texts.
BLOCK_BYTES, CHUNK_BYTES = 2 << 20, 64 << 20
#: Java pattern of what lies between words, once A-Z are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "last_word", "start", "end")]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class Windows:
    """Automaton over all windows of ``items`` [(item id as string or None, text bytes)]."""

    def __init__(self, items: Sequence[tuple[str | None, bytes]], window: int):
        import ahocorasick

        self.ids: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in text.translate(ALNUM_TABLE).split()]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                held.setdefault(tuple(words[i : i + window]), set()).update([item] if item is not None else [])
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, owners in held.items():
            self.found.add_word(key, (len(key), owners))
        self.some = bool(held)
        if self.some:
            self.found.make_automaton()

    def mark(self, words: list[bytes], marks: bytearray | None) -> tuple[bytearray | None, set[str]]:
        """``marks`` of the words, made when there is a first hit, and the items with windows in them."""
        get = self.ids.get
        ids, owners = tuple([get(w, 0) for w in words]), set()
        if self.some and any(ids):
            for end, (n, who) in self.found.iter(ids):
                if marks is None:
                    marks = bytearray(len(words))
                marks[end - n + 1 : end + 1] = b"\1" * n
                owners |= who
        return marks, owners


def _split(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM_TABLE).split()


def _result(text: bytes | None, n: int, marks: bytearray | None, owners: set[str]) -> tuple:
    return (n, 0, [], []) if marks is None else (n, marks.count(1), runs(text, marks), sorted(owners))


def scan_once(windows: Windows, texts: Sequence[bytes | None]) -> list[tuple]:
    out = []
    for t in texts:
        words = _split(t)
        out.append(_result(t, len(words), *windows.mark(words, None)))
    return out


def scan_blocks(blocks: Sequence[Callable[[], Windows]], texts: Sequence[bytes | None]) -> list[tuple]:
    """As ``scan_once``, over the windows of all blocks; only one automaton is held at a time."""
    marks: list[bytearray | None] = [None] * len(texts)
    owners: list[set[str]] = [set() for _ in texts]
    sizes = [0] * len(texts)
    for make in blocks:
        windows = make()
        for i, t in enumerate(texts):
            words = _split(t)
            sizes[i] = len(words)
            marks[i], own = windows.mark(words, marks[i])
            owners[i] |= own
    return [_result(*x) for x in zip(texts, sizes, marks, owners, strict=True)]


def item_pieces(items: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """(item, text): distinct items, those of more than ``block_bytes`` cut into pieces that overlap by all but one word of a window."""
    items = items.where("text is not null").distinct()
    words = F.filter(F.split(lower_ascii(F.col("text")), _BETWEEN), lambda w: w != "")
    step = max(1, block_bytes // 64)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)), F.lit(step))
    big = F.octet_length("text") > block_bytes
    cuts = items.where(big).select("item", words.alias("words")).select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, step + window - 1), " "))).alias("text"))
    return items.where(~big).unionByName(cuts.distinct())


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    fields: Sequence[str] = ("text",),
    window: int = WINDOW,
    out: str = "contamination",
    carry: Sequence[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with the struct ``out``: n_words, n_hit, hits (runs of hit words, with code-point
    offsets [start, end) of the original text), items (sorted as strings).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Every ``window`` consecutive words of a
    benchmark field (question, answer) is a window; a field of fewer words is one window; one without words has none.
    Each text is scanned whole and read once. A null or empty text has no words and no hits. Items without an id mark
    words but are not listed; repeated items count once, before they are taken in. An empty benchmark hits nothing; an
    empty table gives an empty one. A column called ``out`` is replaced. The benchmark is taken in blocks of about
    ``block_bytes`` of its text, each fetched and broadcast by itself; tasks hold the automaton of one block at a time.
    """
    spark = docs.sparkSession
    parts = [benchmark.select(col(item_col).cast("string").alias("item"), col(f).cast("string").alias("text")) for f in fields]
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    items = cut(item_pieces(items, window, block_bytes), "items")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-n_bytes // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    dealt = items if blocks == 1 else cut(items.repartition("block").sortWithinPartitions("block"), "blocks")
    held = [spark.sparkContext.broadcast([(r.item, r.text.encode()) for r in dealt.where(F.col("block") == b).collect()]) for b in range(blocks)]
    discard(items, dealt)

    def make():
        if len(held) == 1:
            windows = Windows(held[0].value, window)
            return lambda texts: scan_once(windows, texts)

        return lambda texts: scan_blocks([lambda b=b: Windows(b.value, window) for b in held], texts)

    return annotate(docs, make, RESULT, out, text_col, carry, chunk_bytes=(8 << 20) if blocks == 1 else CHUNK_BYTES)
