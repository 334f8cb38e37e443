"""MinHash near-duplicate groups: one-permutation sketches with optimal densification, banded buckets, star edges.

Each text becomes the set of its word shingles, hashed to 64 bits. One permutation splits the hash range into bins and
keeps each bin's least value; an empty bin borrows from the first full bin in an order of its own (optimal
densification), so short texts keep independent bins. Bands of bins make buckets. In a bucket only a few pivots are
compared with the rest (a star), never all pairs; what the pivots join is one component and needs no further
comparison. In buckets that still hold several components, the other members pass each other in bounded blocks, so that
no candidate pair is given up, no bucket is capped, and nothing but links is written. Links are confirmed on full
shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK_TABLE, annotate, cut, discard

BANDS, ROWS = 32, 5
#: Pairs whose sketches agree in fewer bins than the threshold less this are dropped before their texts are compared. At a
#: similarity of 0.8 over 160 bins it is 4.6 standard deviations, which a pair misses as rarely as all its bands.
SKETCH_SLACK = 0.145
SALTS = 64
#: Pivots of a bucket's star. In buckets that stars leave open: members and bytes of shingles in a block that is held,
#: and members that pass it in one group.
PIVOTS, BLOCK, BLOCK_BYTES, PASSING = 4, 1024, 32 << 20, 1024
CHUNK = 1000
#: As many wanted ids, of 24 bytes each, are broadcast to the texts at most.
FEW = 500_000
_SLICE = 1 << 20
_SEED = 0x9E3779B97F4A7C15


def _mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher(dict):
    """64-bit keyed BLAKE2 hashes of words, which no choice of words makes collide. Of frequent words they are remembered."""

    KEY = b"word"
    MOST, LONGEST = 300_000, 64

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.KEY).digest(), "little")
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = h
        return h

    def all(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes | None, k: int, hasher: WordHasher):
    """(sorted distinct 64-bit shingle hashes, 16-byte key of the word sequence or None). Fewer than k words: one shingle of all."""
    import numpy as np

    clean = (text or b"").translate(BLANK_TABLE)
    digest = hashlib.blake2b(digest_size=16)
    parts, carry, at, seen = [], np.empty(0, np.uint64), 0, False
    while at < len(clean):
        end = len(clean) if at + _SLICE >= len(clean) else clean.find(b" ", at + _SLICE)
        end = len(clean) if end < 0 else end
        words = clean[at:end].split()
        at = end
        if not words:
            continue
        digest.update(b" ".join(words) + b" ")
        seen = True
        h = np.concatenate((carry, hasher.all(words)))
        n = len(h) - k + 1
        if n > 0:
            s = np.zeros(n, dtype=np.uint64)
            for i in range(k):
                s = s * np.uint64(_SEED) + h[i : i + n]
            parts.append(_mix(s))
        carry = h[max(0, len(h) - k + 1) :]
    if not seen:
        return np.empty(0, np.uint64), None
    if not parts:
        short = hashlib.blake2b(digest.digest(), digest_size=8, key=b"short").digest()
        return np.frombuffer(short, dtype=np.uint64), digest.digest()
    s = np.sort(parts[0] if len(parts) == 1 else np.concatenate(parts))
    fresh = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=fresh[1:])
    return s[fresh], digest.digest()


class Sketcher:
    """Densified one-permutation sketches of ``bands * rows`` bins, and one key a band."""

    def __init__(self, bands: int, rows: int):
        import numpy as np

        self.bands, self.rows, self.k = bands, rows, bands * rows
        rng = np.random.default_rng(20_24)
        # order[j, b]: when bin j is empty, the full bin with the least order lends its value.
        self.order = np.argsort(rng.random((self.k, self.k)), axis=1)
        self.band_seed = rng.integers(1, 1 << 63, bands, dtype=np.uint64)

    def bins(self, hashes):
        """One value a bin, for sorted distinct ``hashes``."""
        import numpy as np

        at = ((hashes >> np.uint64(32)) * np.uint64(self.k)) >> np.uint64(32)
        first = np.ones(len(at), bool)
        np.not_equal(at[1:], at[:-1], out=first[1:])  # the first of a bin is its least
        full = at[first].astype(np.int64)
        out = np.zeros(self.k, np.uint64)
        out[full] = hashes[first]
        if len(full) < self.k:
            empty = np.ones(self.k, bool)
            empty[full] = False
            empty = np.flatnonzero(empty)
            out[empty] = out[full[self.order[empty][:, full].argmin(axis=1)]]
        return out

    def __call__(self, sets):
        """For each set: (band keys, one byte of each bin)."""
        import numpy as np

        if not sets:
            return []
        bins = _mix(np.stack([self.bins(s) for s in sets]))
        key = np.tile(self.band_seed, (len(sets), 1))
        for i in range(self.rows):
            key = _mix(key ^ bins[:, i :: self.rows])
        low = (bins & np.uint64(255)).astype(np.uint8)
        return [(k, b.tobytes()) for k, b in zip(key.view(np.int64).tolist(), low, strict=True)]


_SKETCH = T.StructType(
    [
        T.StructField("node", T.BinaryType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ]
)
_SET = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("hashes", T.BinaryType())])


def _sketched(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    def make():
        hasher, sketch = WordHasher(), Sketcher(bands, rows)

        def run(texts):
            sets = [shingle_set(t, k, hasher) for t in texts]
            made = iter(sketch([s for s, node in sets if node is not None]))
            return [(None, 0, None, None) if node is None else (node, len(s), *next(made)) for s, node in sets]

        return run

    return annotate(docs, make, _SKETCH, "made", text_col, [id_col]).select(F.col(id_col).alias("doc_id"), "made.*")


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes in ``wanted`` (node, doc_id), computed from their texts again."""

    def make():
        hasher = WordHasher()

        def run(texts):
            return [(n, s.tobytes()) for s, n in (shingle_set(t, k, hasher) for t in texts)]

        return run

    ids = wanted.select(F.col("doc_id").alias("wanted_id"), F.col("node").alias("wanted_node"))
    if wanted.count() <= FEW:  # else texts are shuffled by id
        ids = F.broadcast(ids)
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    return annotate(found, make, _SET, "made", "text", ["wanted_node"]).where("made.node = wanted_node").select("made.*").dropDuplicates(["node"])


def _alike(edges: DataFrame, reps: DataFrame, share: float) -> DataFrame:
    """Edges (pivot, node) whose sketches agree in at least ``share`` of the bins."""
    side = reps.select("node", "sketch")
    both = edges.join(side.toDF("pivot", "a"), "pivot").join(side.toDF("node", "b"), "node")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (np.frombuffer(b"".join(x.as_py() for x in batch.column(c)), np.uint8).reshape(n, -1) for c in ("a", "b"))
            keep = (a == b).mean(axis=1) >= share
            yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("node")], names=["pivot", "node"]).filter(pa.array(keep))

    return both.select("pivot", "node", "a", "b").mapInArrow(run, "pivot binary, node binary")


def _confirmed(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (pivot, node) with den * intersection >= num * union on the full sets.

    The rows of a pivot are cut into chunks of about CHUNK members; each chunk gets the pivot's set once, sorted to its
    front, and streams past it, so one set is held at a time however large the star is.
    """
    degree = cut(edges.groupBy("pivot").agg(F.count(F.lit(1)).alias("degree")), "degree")
    members = edges.join(degree, "pivot").select(
        "pivot", F.pmod(F.xxhash64("node"), F.ceil(F.col("degree") / CHUNK)).alias("chunk"), F.lit(1).alias("turn"), "node"
    )
    pivots = members.select("pivot", "chunk").distinct().select("pivot", "chunk", F.lit(0).alias("turn"), F.col("pivot").alias("node"))
    rows = members.unionByName(pivots).join(sets, "node").repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", "turn")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pivot, base = None, None
        for batch in batches:
            out_p, out_n = [], []
            for p, turn, node, h in zip(*(batch.column(c) for c in ("pivot", "turn", "node", "hashes")), strict=True):
                p, h = p.as_py(), np.frombuffer(h.as_py(), np.uint64)
                if turn.as_py() == 0:
                    pivot, base = p, h
                elif p == pivot:
                    at = np.searchsorted(base, h)
                    both = int((base[np.minimum(at, len(base) - 1)] == h).sum())
                    if den * both >= num * (len(base) + len(h) - both):
                        out_p.append(p)
                        out_n.append(node.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out_p, pa.binary()), pa.array(out_n, pa.binary())], names=["pivot", "node"])

    return rows.select("pivot", "turn", "node", "hashes").mapInArrow(run, "pivot binary, node binary")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every end of ``edges`` (pivot, node).

    Least labels spread over the edges and jump to their label's label, so that long chains halve at each turn. Both
    tables of a turn are written to the shared folder; its joins shuffle plain tables, so hot hubs can be split.
    """
    ab = cut(edges.select(F.col("pivot").alias("u"), F.col("node").alias("v")).union(edges.select("node", "pivot")), "links")
    table = cut(ab.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("v", "node").alias("label")), "labels")
    while True:
        labels = table.select("node", "label")
        near = cut(ab.join(labels, ab.v == labels.node).groupBy("u").agg(F.min("label").alias("least")), "near")
        hop = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        moved = labels.join(near, labels.node == near.u).join(hop, F.col("label") == F.col("at"), "left")
        moved = cut(moved.select("node", F.col("label").alias("old"), F.least("label", "least", "far").alias("label")), "moved")
        discard(near, table)
        table = moved
        if moved.where("label <> old").isEmpty():
            discard(ab)
            return moved.select("node", "label")


def _joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``labels`` brought up to date with new edges, which count as edges between the components they touch."""
    if labels is None:
        return connected(edges)
    p, n = (labels.select(F.col("node").alias(f"{x}_node"), F.col("label").alias(x)) for x in ("p", "n"))
    between = edges.join(p, F.col("pivot") == F.col("p_node"), "left").join(n, F.col("node") == F.col("n_node"), "left")
    between = cut(between.select(F.coalesce("p", "pivot").alias("pivot"), F.coalesce("n", "node").alias("node")).where("pivot <> node").distinct(), "between")
    if between.isEmpty():
        return labels
    to = connected(between).select(F.col("node").alias("old"), F.col("label").alias("new"))
    moved = labels.join(to, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = to.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return cut(moved.unionByName(fresh), "labels")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    num: int = 80,
    den: int = 100,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least doc_id reachable over links), kept.

    Two texts link when ``den * |A and B| >= num * |A or B|`` over their sets of ``shingle``-word shingles; words are runs
    between ASCII blanks with A-Z lower-cased. Texts with fewer words are one shingle; null, empty and blank texts have
    none and link with nothing. Equal word sequences are one node of the graph, so copies cost one row each.
    Nulls and repeats: a null id never names a component; a component of null ids only has a null component_id and keeps
    its rows; repeated rows with the id of the component are all marked kept. An empty table gives an empty result.
    Other columns are not read. A pair at the threshold misses every band with probability 3e-6.
    """
    share = num / den - SKETCH_SLACK
    old: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        old.append(cut(df, name))
        return old[-1]

    made = keep(_sketched(docs, id_col, text_col, shingle, bands, rows), "sketched")
    slim = made.select("doc_id", "node", "n_shingles")
    reps = keep(made.where("node is not null").dropDuplicates(["node"]), "reps")
    live = _shared_members(reps, keep)
    ids = reps.select("node", "doc_id")
    fetch = lambda nodes: keep(_sets(docs, id_col, text_col, shingle, keep(nodes.join(ids, "node"), "wanted")), "sets")
    # stars: the first members of each bucket, of each of its salted parts first, against all of it
    salted = live.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    chosen = keep(_first(["key"], _first(["key", "salt"], salted, PIVOTS), PIVOTS).select("key", F.col("node").alias("pivot"), F.col("n_shingles").alias("n_pivot")), "pivots")
    close = F.least("n_shingles", "n_pivot") * den >= F.greatest("n_shingles", "n_pivot") * num
    star = live.join(chosen, "key").where((F.col("node") != F.col("pivot")) & close).select("pivot", "node").distinct()
    found = keep(_alike(star, reps, share), "alike")
    labels, sets = None, None
    if not found.isEmpty():
        sets = fetch(found.select("node").union(found.select("pivot")).distinct())
        new = keep(_confirmed(found, sets, num, den), "edges")
        labels = None if new.isEmpty() else _joined(labels, new)
    # blocks: pivots are done with, and so are buckets whose other members are one component
    rest = live.join(chosen.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti").select("key", "node", "n_shingles")
    rest = rest.withColumn("label", F.col("node")) if labels is None else rest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = keep(rest.select("key", "node", "n_shingles", "label"), "rest")
    split = rest.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("held")).where("a <> z")
    rest = keep(rest.join(keep(split.select("key", "n", "held"), "open"), "key"), "members")
    if not rest.isEmpty():
        nodes = rest.select("node").distinct()
        more = fetch(nodes if sets is None else nodes.join(sets.select("node"), "node", "left_anti"))
        new = keep(_compared(rest, reps, more if sets is None else sets.unionByName(more), share, num, den), "edges")
        if not new.isEmpty():
            labels = _joined(labels, new)
    if labels is None:
        placed = slim.withColumn("label", F.col("node"))
    else:
        placed = slim.join(labels, "node", "left").select("doc_id", "node", "n_shingles", F.coalesce("label", "node").alias("label"))
    placed = cut(placed, "placed")
    discard(*old)
    least = cut(placed.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return (
        placed.join(least, "label", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _shared_members(reps: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(key, node, n_shingles, turn): the members of buckets that hold two nodes or more, and who becomes a pivot first:
    the nodes that meet most others, alike in every bucket, so that a group meets in few stars."""
    banded = reps.select("node", "n_shingles", F.explode("bands").alias("key"))
    shared = keep(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    live = keep(banded.join(shared, "key").select("key", "node", "n_shingles", "n").distinct(), "shared_members")
    weight = live.groupBy(F.col("node").alias("at")).agg((-F.sum("n")).alias("turn"))
    return keep(live.join(weight, F.col("node") == F.col("at")).select("key", "node", "n_shingles", "turn"), "members")


def _compared(members: DataFrame, reps: DataFrame, sets: DataFrame, share: float, num: int, den: int) -> DataFrame:
    """Links (pivot, node) among the members (key, node, n_shingles, label, n, held) of each bucket, of different labels.

    A bucket's members are dealt to blocks, bounded in number and bytes, and anew to parts. A part passes a block in a
    group of its own, where each member is compared with the block in memory, so that no pair is written but a link. A
    member passes its own block and those before it, so that two blocks meet once. A pair that meets in several buckets
    is compared in that of its first common band alone.
    """
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("held") * 8 / BLOCK_BYTES)).cast("int")
    parts = F.ceil(F.col("n") / PASSING).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("parts", parts)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    rows = dealt.join(reps.select("node", "bands", "sketch"), "node").join(sets, "node")
    names = ("key", "block", "part", "turn", "node", "label", "bands", "sketch", "hashes", "within")
    place = lambda block, part, turn: F.struct(block.alias("block"), part.alias("part"), F.lit(turn).alias("turn"))
    held = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: place(F.col("own"), p, 0))
    passing = F.transform(F.sequence(F.lit(0), F.col("own")), lambda b: place(b, F.col("part"), 1))
    rows = rows.withColumn("at", F.explode(F.concat(held, passing))).withColumn("within", F.col("at.block") == F.col("own"))
    rows = rows.select("key", "at.block", "at.part", "at.turn", *names[4:])
    rows = rows.repartition("key", "block", "part").sortWithinPartitions("key", "block", "part", "turn")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, held = None, []
        nodes = labels = bands = sketches = sizes = None
        for batch in batches:
            out_p, out_n = [], []
            for key, block, part, turn, node, label, own, sketch, h, within in zip(*(batch.column(c) for c in names), strict=True):
                key, node, label, within = key.as_py(), node.as_py(), label.as_py(), within.as_py()
                group = key, block.as_py(), part.as_py()
                own, sketch, h = own.values.to_numpy(), np.frombuffer(sketch.as_py(), np.uint8), np.frombuffer(h.as_py(), np.uint64)
                if group != at:
                    at, held, nodes = group, [], None
                if turn.as_py() == 0:
                    held.append((node, label, own, sketch, h))
                    continue
                if not held:
                    continue
                if nodes is None:
                    nodes, labels, bands, sketches = ([x[i] for x in held] for i in range(4))
                    bands, sketches, sizes = np.stack(bands), np.stack(sketches), np.array([len(x[4]) for x in held])
                same = bands == own
                first = same[np.arange(len(held)), same.argmax(axis=1)] & (own[same.argmax(axis=1)] == key)
                near = np.minimum(sizes, len(h)) * den >= np.maximum(sizes, len(h)) * num
                for i in np.flatnonzero(first & near & ((sketches == sketch).mean(axis=1) >= share)):
                    if labels[i] != label and (nodes[i] < node or not within):
                        base = held[i][4]
                        where = np.searchsorted(base, h)
                        both = int((base[np.minimum(where, len(base) - 1)] == h).sum())
                        if den * both >= num * (len(base) + len(h) - both):
                            out_p.append(nodes[i])
                            out_n.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(out_p, pa.binary()), pa.array(out_n, pa.binary())], names=["pivot", "node"])

    return rows.mapInArrow(run, "pivot binary, node binary")


def _first(keys: list[str], df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("turn", "node"))
    return df.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents kept by ``near_duplicates``, with all their columns.

    Of rows that repeat id and text one stays. Rows without an id stay if one of them is kept. Null, empty and blank
    texts are linked with nothing, so they stay. An empty table stays one. Other columns are carried along, whatever their names.
    """
    keep = cut(near_duplicates(docs, id_col, text_col, **how).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct(), "kept")
    # a plain join deals texts out by id once, and the last step needs no other order; nulls don't join by it
    kept = docs.join(keep, F.col(id_col) == F.col("__kept_id"))
    nulls = docs.where(F.col(id_col).isNull()).join(keep.where("__kept_id is null"), F.col(id_col).eqNullSafe(F.col("__kept_id")))
    once = lambda df: df.drop("__kept_id").dropDuplicates([id_col, text_col])
    return once(kept).unionByName(once(nulls))
