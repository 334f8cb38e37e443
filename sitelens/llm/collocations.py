"""Phrase collocations from sorted count streams, after the external estimation of n-gram models.

1. Texts are read once into blocks: a stream of word numbers, and the block's own vocabulary with counts.
2. Vocabularies are summed. Rare words can be in no phrase, so they break the stream like a separator.
3. Each place of a stream gives one row, the words from there to the next break, five at most; blocks sum equal rows. No
   shorter phrase gets rows of its own.
4. Rows are dealt out by their first word, or, where that is hot, by their words up to the first that isn't, and sorted
   in prefix order. The count of a phrase is the sum over the run of rows that begin with it, for all lengths in one pass
   over the sorted stream; phrases of hot words alone, whose rows lie in many tasks, are summed once more.
5. The counts of the frequent phrases are kept in prefix order, where a phrase follows its own prefixes, and then in
   suffix order (words reversed), where it follows its suffixes. One merging pass over either gives the counts of all
   left or right parts and of the extensions by a word; nothing is looked up by hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, discard, ranked

#: Bytes of text in a block. A longer text is cut between pieces, which are independent.
BLOCK_BYTES = 8 << 20
#: Words that three 64-bit keys hold, two each but for the last, whose lower half has a row's count.
MOST_WORDS = 5
#: Words rarer than this are left out of the streams. Any value up to the phrases' least count gives the same phrases; at a
#: low one the work per text does not depend on the corpus's size.
RARE = 5
#: A word with more than this part of all words is hot; so there are at most so many hot ones. The last bit of its id tells.
MOST_HOT = 1000
#: Bytes that end a piece; blanks between words are space and tab.
_ENDS = b".,;:!?\n\x0b\x0c\r"
#: No byte of UTF-8: stands for the end of a piece.
_BREAK = b"\xff"


def _blocks(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(block, stream, words): streams of 32-bit numbers, 0 between pieces, words numbered from 1 as they stand in ``words``."""
    src = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"), col(text_col).cast("string").alias("text")).where("text <> ''")

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa

        upper, lower = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
        table = bytes.maketrans(upper + _ENDS + b"\t", lower + _BREAK * len(_ENDS) + b" ")
        word_type = pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

        def flush(held):
            streams, words, base = [], [], 0
            for lang, texts in held.items():
                at = {_BREAK: 0}
                tokens = (b" " + _BREAK + b" ").join(texts).replace(_BREAK, b" " + _BREAK + b" ").split()
                ids = np.array([at.setdefault(w, len(at)) for w in tokens], dtype=np.int64)
                names = list(at)[1:]
                counts = np.bincount(ids, minlength=len(at))[1:]
                rank = np.argsort(-counts, kind="stable")  # frequent words get small numbers
                number = np.zeros(len(at), dtype=np.int64)
                number[rank + 1] = np.arange(1, len(rank) + 1) + base
                streams += [number[ids].astype("<u4"), np.zeros(1, "<u4")]
                words += [{"lang": lang, "word": names[i].decode(), "n": int(counts[i])} for i in rank.tolist()]
                base += len(names)
            raw = np.concatenate(streams).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([raw], pa.binary()), pa.array([words], pa.list_(word_type))], names=["block", "stream", "words"])

        def parts(text):
            at = 0
            while len(text) - at > BLOCK_BYTES:
                end = text.rfind(_BREAK, at, at + BLOCK_BYTES)
                if end < 0 and (end := text.find(_BREAK, at + BLOCK_BYTES)) < 0:
                    break
                yield text[at:end]
                at = end + 1
            yield text[at:]

        held, size = {}, 0
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text"), strict=True):
                for part in parts(text.as_py().encode().translate(table)):
                    held.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= BLOCK_BYTES:
                        yield flush(held)
                        held, size = {}, 0
        if held:
            yield flush(held)

    return src.mapInArrow(run, "block long, stream binary, words array<struct<lang:string,word:string,n:long>>")


def _grams(blocks: DataFrame, known: DataFrame, longest: int) -> DataFrame:
    """(k1, k2, k3): a row for each distinct run of known words, ``longest`` at most, that starts somewhere in a block; how often it does is in k3."""

    def run(streams, ids):
        import numpy as np
        import pyarrow as pa

        number, ident = ids.column("number").to_numpy(), ids.column("id").to_numpy()
        out = []
        for raw in streams.column("stream"):
            stream = np.frombuffer(raw.as_py(), "<u4")
            table = np.zeros(max(int(stream.max(initial=0)), int(number.max(initial=0))) + 1, dtype=np.int64)
            table[number] = ident
            words = np.concatenate((table[stream], np.zeros(longest, np.int64)))
            first = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0))
            row, alive = [words[first]], np.ones(len(first), dtype=bool)
            for k in range(1, MOST_WORDS):
                alive = alive & (words[first + min(k, longest - 1)] > 0) & (k < longest)
                row.append(np.where(alive, words[first + min(k, longest - 1)], 0))
            keys = [row[0] << 32 | row[1], row[2] << 32 | row[3], row[4] << 32]
            order = np.lexsort(keys[::-1])
            keys = [k[order] for k in keys]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])
            at = np.flatnonzero(new)
            keys = [k[at] for k in keys]
            out.append([keys[0], keys[1], keys[2] | np.diff(np.append(at, len(order)))])
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "k3"])

    return blocks.select("block", "stream").groupBy("block").cogroup(known.groupBy("home")).applyInArrow(run, "k1 long, k2 long, k3 long")


def _masks(k: int) -> list[int]:
    """Bits of the three keys that hold the first ``k`` words."""
    one = [0, -1 << 32, -1]
    return [one[min(2, max(0, k - 2 * i))] for i in range(3)]


def _prefix_counts(grams: DataFrame, longest: int, least: int) -> DataFrame:
    """(k1, k2, k3, a): phrases of two words and more whose count ``a`` reaches ``least``."""
    ids = _words(longest)
    key = F.xxhash64(*ids)
    for k in range(longest - 1, 0, -1):
        key = F.when(ids[k - 1].bitwiseAND(F.lit(1)) == 0, F.xxhash64(*ids[:k])).otherwise(key)
    ordered = grams.repartition(key).sortWithinPartitions("k1", "k2", "k3")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        orders = range(2, longest + 1)
        pending: dict[int, tuple | None] = dict.fromkeys(orders)  # the run that may go on: (keys, count, whether other tasks may have more of it)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["k1", "k2", "k3", "a"])
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            n, keys[2] = keys[2] & 0xFFFFFFFF, keys[2] >> 32 << 32
            done = []
            for k in orders:
                words = [(keys[i // 2] >> 32) if i % 2 == 0 else keys[i // 2] & 0xFFFFFFFF for i in range(k)]
                there = np.flatnonzero(words[-1] != 0)
                if not len(there):
                    continue
                own = [key[there] & mask for key, mask in zip(keys, _masks(k), strict=True)]
                new = np.ones(len(there), dtype=bool)
                new[1:] = (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1]) | (own[2][1:] != own[2][:-1])
                at = np.flatnonzero(new)
                sums, own = np.add.reduceat(n[there], at), [x[at] for x in own]
                hot = np.logical_and.reduce([w[there][at] & 1 == 1 for w in words])
                if before := pending[k]:
                    if all(x[0] == y for x, y in zip(own, before[0], strict=True)):
                        sums[0] += before[1]
                    elif before[1] >= least or before[2]:
                        done.append([np.array([v]) for v in (*before[0], before[1])])
                pending[k] = ([x[-1] for x in own], int(sums[-1]), bool(hot[-1]))
                out = np.flatnonzero((sums[:-1] >= least) | hot[:-1])
                done.append([*[x[out] for x in own], sums[out]])
            if done:
                yield batch_of([np.concatenate([d[i] for d in done]) for i in range(4)])
        last = [(*p[0], p[1]) for p in pending.values() if p]
        if last:
            yield batch_of(list(zip(*last, strict=True)))

    parts = ordered.mapInArrow(run, "k1 long, k2 long, k3 long, a long")
    return parts.groupBy("k1", "k2", "k3").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _words(longest: int) -> list[Column]:
    """The word ids that the keys hold; 0 beyond the phrase's end."""
    half = lambda i: F.shiftright(F.col(f"k{i // 2 + 1}"), 32) if i % 2 == 0 else F.col(f"k{i // 2 + 1}").bitwiseAND(F.lit(0xFFFFFFFF))
    return [half(i).cast("int") for i in range(longest)]


def _merged(rows: DataFrame, words: list[str], part: str, longer: str) -> DataFrame:
    """Adds the counts of each row's first 2, 3... words as ``part``2... and the highest count of a row one word longer as ``longer``.

    Rows are dealt out by their first two words and sorted by all of them once; every window reads that order, in which a
    phrase comes before those that begin with it.
    """
    most = len(words)
    out = rows.repartition(*words[:2]).sortWithinPartitions(*words)
    ends = []
    for k in range(2, most):
        group = Window.partitionBy(*words[:k])
        out = out.withColumn(f"{part}{k}", F.first("a").over(group.orderBy(*words[k:])))
        out = out.withColumn(f"__{k}", F.max(F.when(F.col("m") == k + 1, F.col("a"))).over(group.orderBy(*words[k:]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        ends.append((k, f"__{k}"))
    value = F.lit(None).cast("long")
    for k, name in ends:
        value = F.when(F.col("m") == k, F.col(name)).otherwise(value)
    return out.withColumn(longer, value).drop(*[name for _, name in ends])


def _top(rows: DataFrame, group: str, order: list[Column], spread: Column, top: int, total: int) -> DataFrame:
    """The first ``top`` rows of each group and their ``rank`` from 1: first in parts of a group, then among the parts' first ones."""
    parts = max(1, math.isqrt(total // top))
    rank = F.row_number()
    some = rows.withColumn("__part", F.pmod(spread, F.lit(parts)))
    some = some.withColumn("rank", rank.over(Window.partitionBy(group, "__part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", rank.over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= top).drop("__part")


def mine_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 5,
    least: int = 100,
    percent: int = 100,
    top: int = 2000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): each language's ``top`` phrases by score, then a, then the phrase.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?]``, line feeds and their like into pieces, pieces at spaces and
    tabs into words. Phrases have 2 to ``longest`` words (5 at most) of a piece; n counts a language's words, a a
    phrase's occurrences, overlaps included. A cut after the first ``cut`` words has l = count of the first part, r =
    count of the rest, score = floor(1000 * a * n / (l * r)), computed in 38 decimal digits; the lowest-scoring cut
    counts, of equal ones the first. Phrases below ``least`` are left out, and so are those inside a longer one that has
    at least ``percent`` per cent of their occurrences (such a one exists only if it does among those longer by a word).

    Null and empty texts have no words; a null language is ``und``. Repeated rows count each. Languages without phrases
    have no rows; an empty table gives an empty result. Other columns are not read.
    """
    if not 2 <= longest <= MOST_WORDS:
        raise ValueError(f"phrases have 2 to {MOST_WORDS} words")
    blocks = cut(_blocks(docs, text_col, lang_col), "blocks")
    each = blocks.select("block", F.posexplode("words").alias("number", "w")).select("block", (F.col("number") + 1).alias("number"), F.col("w.lang").alias("lang"), F.col("w.word").alias("word"), F.col("w.n").alias("n"))
    counts = cut(each.groupBy("lang", "word").agg(F.sum("n").alias("f")), "counts")
    totals = cut(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    hot = F.col("f") > (totals.agg(F.sum("n")).first()[0] or 0) // MOST_HOT
    frequent = counts.where(F.col("f") >= min(RARE, least)).select(F.struct((-F.col("f")).alias("turn"), "lang", "word").alias("key"), "f")  # frequent words get small ids, which take less room
    frequent = cut(frequent, "frequent")
    discard(counts)
    numbered = ranked(frequent, "key").select(((F.col("rank") + 1) * 2 + hot.cast("int")).cast("int").alias("id"), "key.lang", "key.word", "f")
    words = cut(numbered.join(totals, "lang"), "words")
    known = each.drop("n").join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("home"), "number", "id")
    phrases = cut(_prefix_counts(_grams(blocks, known, longest), longest, least), "phrases")
    discard(blocks, frequent)
    total = phrases.count()

    names = [f"w{i + 1}" for i in range(longest)]
    rows = phrases.select(*[w.alias(n) for n, w in zip(names, _words(longest), strict=True)], "a")
    m = sum((F.when(F.col(n) > 0, 1).otherwise(0) for n in names[2:]), F.lit(2))
    rows = rows.withColumn("m", m)
    back = [f"v{i + 1}" for i in range(longest)]
    turned = F.reverse(F.array(*[F.col(n) for n in names]))
    at = lambda i: F.coalesce(F.get(turned, F.lit(longest + i) - F.col("m")), F.lit(0))
    rows = rows.select(*names, *[at(i).alias(b) for i, b in enumerate(back)], "a", "m")
    ends = words.select(F.col("id").alias("i1"), "lang", "n", F.col("f").alias("l1")), words.select(F.col("id").alias("i2"), F.col("f").alias("r1"))
    rows = rows.join(ends[0], F.col("w1") == F.col("i1")).join(ends[1], F.col("v1") == F.col("i2")).drop("i1", "i2")
    rows = _merged(_merged(rows, names, "l", "right"), back, "r", "left")

    wide = lambda c: F.col(c).cast("decimal(19,0)")

    def split(k: int, size: int) -> Column:
        left, right = f"l{k}", f"r{size - k}"
        score = F.call_function("div", (wide("a") * wide("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"), wide(left) * wide(right))
        return F.struct(score.alias("score"), F.lit(k).alias("cut"), F.col(left).alias("l"), F.col(right).alias("r"))

    best = F.lit(None)
    for size in range(2, longest + 1):
        best = F.when(F.col("m") == size, F.array_min(F.array(*[split(k, size) for k in range(1, size)]))).otherwise(best)
    longer = F.coalesce(F.greatest("left", "right"), F.lit(0))
    scored = cut(rows.where(F.lit(100) * longer < F.lit(percent) * F.col("a")).select("lang", "n", "a", *names, best.alias("b")).select("lang", "n", "a", *names, "b.*"), "scored")
    order = [F.col("score").desc(), F.col("a").desc()]
    spread = F.xxhash64(*names)
    # the last score and count within the top, then all phrases that reach them, with their words
    floor = _top(scored.select("lang", "score", "a", *names), "lang", order, spread, top, total).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least"))
    near = scored.join(floor, "lang").where(F.struct("score", "a") >= F.col("least")).drop("least")
    spelt = cut(near.withColumn("phrase_id", F.struct(*names)), "near")
    text = spelt.select("phrase_id", F.posexplode(F.filter(F.array(*names), lambda w: w > 0)).alias("place", "id")).join(words.select("id", "word"), "id")
    text = text.groupBy("phrase_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x.getField("word")), " ").alias("phrase"))
    final = _top(spelt.join(text, "phrase_id"), "lang", [*order, F.col("phrase").asc()], spread, top, total)
    long = lambda c: F.col(c).cast("long").alias(c)
    return final.select("lang", long("rank"), "phrase", *[long(c) for c in ("a", "l", "r", "n", "score")], "cut")
