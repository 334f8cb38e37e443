"""Training-data operators against brute force, round trips and held-out accuracy, on rows with every edge case."""

import collections
import hashlib
import itertools
import math
import os
import re
import zlib

import pytest
from oracle import SF, connect, same, there
from pyspark.sql import functions as F

import corpus_pipeline
from sitelens.llm import decontaminate as D
from sitelens.llm import licenses as L
from sitelens.llm import mixing as M
from sitelens.llm import near_dedup as N
from sitelens.llm import quality as Q
from sitelens.llm import sharding as S
from sitelens.llm import token_counts as K
from sitelens.llm import toxicity as X
from sitelens.llm import url_filters as U
from sitelens.llm import warc as W
from sitelens.llm.queries import ORACLES, QUERIES

BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE.replace("w30", "zz")
LONG = " ".join(f"v{i % 977}" for i in range(20_000))
ROWS = [
    (1, BASE, "en", "a", 1, 7.5),
    (2, NEAR, "en", "a", 1, 7.5),
    (3, BASE.upper(), "en", "a", 1, 7.5),
    (4, None, None, None, None, None),
    (5, "", "de", "b", 0, 1.0),
    (6, " \n\t ", "de", "b", 3, 1.0),
    (7, "one two", "fr", "b", 7, 1.0),
    (8, "one two", "fr", "c", 7, 1.0),
    (8, "one two", "fr", "c", 7, 1.0),
    (None, "é ünï 漢字 text", "fr", "c", 14, 1.0),
    (10, LONG, "en", "c", len(LONG), 1.0),
    (11, "Licensed under the Apache License, Version 2.0. All rights reserved; cc by cc by", "en", None, 5, None),
    (12, "This work is licensed under the GNU General Public License, version 3.", "en", "d", 5, None),
]
#: score and size clash with columns that operators make.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("Toxicity", F.lit("own")).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def blank(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.skipif(not there(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], connect())


def test_warc_round_trip(spark, docs, none):
    index = W.write_warc(docs, "doc_id", "source", "text")
    got = W.read_warc(index).collect()
    assert len(got) == len(ROWS)
    best = {}
    for i, t, *_ in ROWS:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    for r in got:
        i = None if r.record_id == "none" else int(r.record_id)
        t = next(x[1] for x in ROWS if x[0] == i) or ""
        assert r.payload_bytes == len(t.encode())
        assert (r.record_type == "response") == (i == best[t] or best[t] == -1)
        assert bytes(r.payload) == (t.encode() if r.record_type == "response" else b"")
    few = index.where("record_id in ('1', '10', '12')")
    assert sorted(r.record_id for r in W.read_warc(few, window_bytes=64, gap_bytes=0).collect()) == ["1", "10", "12"]
    assert W.read_warc(W.write_warc(none, "doc_id", "source", "text")).count() == 0
    assert W.coalesced([(50, 10), (0, 10), (12, 5)], 4) == [(0, 17, [(0, 10), (12, 5)]), (50, 60, [(50, 10)])]


def test_urls_spread_over_links(spark):
    link = lambda h: f'<a href="https://{h}/">x</a>'
    rows = [
        (1, "https://good.org/a", link("friend.net")),
        (2, "https://friend.net/b", ""),
        (3, "https://Bad.com/x", ""),
        (4, "https://fan.net/c", link("bad.com")),
        (5, None, None),
        (6, "no scheme", link("good.org")),
        (7, "https://alone.net?q", ""),
    ]
    p = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("host", F.lit(1))
    rules = [U.UrlRule("allow", "org/"), U.UrlRule("block", "bad.com/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(p, rules).collect()}
    assert got[1] == ("good.org", "/a", "org/", "allow") and got[3] == ("bad.com", "/x", "bad.com/", "block")
    assert got[2][3] == "allow" and got[4][3] == "block" and got[5] == ("", "", None, "block") and got[6][0] == ""
    assert got[7] == ("alone.net", "", None, "allow")
    assert U.judge_urls(p.where("false"), rules).count() == 0 and U.judge_urls(p, []).count() == len(rows)


def test_distrust_has_no_horizon(spark):
    """Hosts many links from a blocked one, and hosts whose distrust is below 1e-12."""
    link = lambda h: f'<a href="https://{h}/">x</a>'
    chain = [(i, f"https://c{i}.net/", link(f"c{i - 1}.net") if i > 1 else link("seed.bad")) for i in range(1, 11)]
    rows = [(0, "https://seed.bad/", ""), *chain, (30, "https://fine.org/", link("kin.net")), (31, "https://kin.net/", "")]
    rules = [U.UrlRule("allow", "org/"), U.UrlRule("block", "bad/")]
    got = {r.page_id: r.verdict for r in U.judge_urls(spark.createDataFrame(rows, "page_id int, url string, html string"), rules).collect()}
    assert {i for i, v in got.items() if v == "allow"} == {30, 31}
    many = spark.range(100_000).selectExpr("concat('https://h', id, '.bad/') as url", "'' as html")
    hubs = spark.range(4000).selectExpr("concat('https://', if(id < 2000, 'f', 'g'), id % 2000, '.net/') as url", """concat('<a href="https://', if(id < 2000, 'h0.bad', 'f0.net'), '/">') as html""")
    far = U.judge_urls(many.unionByName(hubs), rules).where("by = 'graph'").groupBy("verdict").count().collect()
    assert [(r.verdict, r["count"]) for r in far] == [("block", 4000)]


def test_uncrawled_hosts_are_seeds(spark):
    """A blocked host without pages, and hosts known by links alone, count as those with pages."""
    link = lambda *urls: "".join(f'<a href="{u}">x</a>' for u in urls)
    rows = [
        (1, "https://fan.net/c", link("https://bad.com/x", "https://bad.com/x", "https://Bad.com/y")),
        (2, "https://kin.net/", link("https://fan.net/c")),
        (3, "https://mild.net/", link("https://good.org/")),
        (4, "https://half.net/", link("https://two.faced/in/a", "https://good.org/")),
    ]
    p = spark.createDataFrame(rows, "page_id int, url string, html string")
    rules = [U.UrlRule("block", "bad.com/"), U.UrlRule("allow", "org/"), U.UrlRule("block", "two.faced/in/")]
    assert {r.page_id: r.verdict for r in U.judge_urls(p, rules).collect()} == {1: "block", 2: "block", 3: "allow", 4: "block"}


def test_hot_hosts_and_payloads_are_split(spark, monkeypatch):
    """Rows of hot keys are dealt to parts; the result is that of a plain join."""
    from sitelens.llm import common as C

    monkeypatch.setattr(C, "HOT_ROWS", 3)
    rows = spark.range(60).selectExpr("id", "if(id < 50, 'hot', concat('k', id % 4)) as k")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    got = C.join_split(rows.unionByName(spark.createDataFrame([(99, "none"), (98, None)], "id long, k string")), C.cut(table), "k", "n", F.xxhash64("id"))
    assert got.columns == ["id", "k", "m"]
    most = {r.k: r.m for r in table.collect()}
    assert sorted((r.id, r.m) for r in got.collect()) == sorted([(i, most["hot" if i < 50 else f"k{i % 4}"]) for i in range(60)] + [(99, None), (98, None)])
    payloads = spark.range(40).selectExpr("id as page_id", "'u' as url", "if(id < 30, 'same', if(id < 35, null, concat('p', id))) as html")
    got = {r.record_id: (r.record_type, r.refers_to) for r in W.read_warc(W.write_warc(payloads)).collect()}
    assert all(got[str(i)] == (("response", None) if i in (29, 34) or i > 34 else ("revisit", "29" if i < 30 else "34")) for i in range(40))


def test_ranks_are_the_fixed_point(spark):
    """A parent domain with hosts of unequal weight, whose terms swing to and fro, against the linear system."""
    import numpy as np

    hosts = spark.createDataFrame([("p", 0.25, 0.0), ("a", 0.75, 0.1), ("b", 0.0, 0.9)], "host string, good double, bad double")
    edges = [("p", "a", 1), ("a", "p", 1), ("p", "b", 3), ("b", "p", 3)]
    got = {r.host: r for r in U.propagate(hosts, spark.createDataFrame(edges, "src string, dst string, weight long")).collect()}
    m = np.zeros((3, 3))
    for s, d, w in edges:
        m["pab".index(d), "pab".index(s)] = w / sum(x[2] for x in edges if x[0] == s)
    for name, seed in (("trust", [0.25, 0.75, 0.0]), ("distrust", [0.0, 0.1, 0.9])):
        want = np.linalg.solve(np.eye(3) - U.DAMPING * m, (1 - U.DAMPING) * np.array(seed))
        assert np.allclose([got[h][name] for h in "pab"], want, rtol=1e-9, atol=0)


@pytest.mark.skipif(not os.path.exists(K.TOKENIZER), reason="no tokenizer files")
@pytest.mark.parametrize("block", [K.BLOCK_BYTES, 64])
def test_token_counts(spark, docs, none, block):
    enc, _ = K.load_encoding(K.vocabulary(K.TOKENIZER))
    want = sorted((str(i), len(enc.encode_ordinary(t or ""))) for i, t, *_ in ROWS)
    assert sorted((str(r.doc_id), r.n_tokens) for r in K.count_tokens(docs, block_bytes=block).collect()) == want
    assert K.count_tokens(none).count() == 0


@pytest.mark.skipif(not os.path.exists(K.TOKENIZER), reason="no tokenizer files")
def test_tokens_of_very_long_texts(spark, monkeypatch):
    """Blank runs on which the pattern engine overflows, and cuts of shorter ones against the engine."""
    enc, _ = K.load_encoding(K.vocabulary(K.TOKENIZER))
    size = lambda s: len(enc._encode_single_piece(s))
    rows = [(1, " " * 2_000_000), (2, "a" + "\n" * 1_000_000 + "b"), (3, "x" * 2_000_000), (4, "\t" * 5000 + " b")]
    want = {1: size(" " * 2_000_000), 2: 3 + size("\n" * 999_999), 3: size("x" * 2_000_000), 4: size("\t" * 5000) + size(" b")}
    assert {r.doc_id: r.n_tokens for r in K.count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    monkeypatch.setattr(K, "_LONG_RUN", re.compile(K._LONG_RUN.pattern.replace(str(K.LONG_BLANK), "3")))
    for mix in itertools.product(["a", " ", "   ", "\n\n\n\n", "\u3000\u3000\u3000", "!'s"], repeat=4):
        assert K.token_ids(enc, "".join(mix)) == enc.encode_ordinary("".join(mix))


def test_scan_of_foreign_file(spark, tmp_path):
    import numpy as np

    np.array([5, 6, 9, 9, 7, 8, 8], "<u2").tofile(tmp_path / "t.bin")
    files = spark.createDataFrame([("file://" + str(tmp_path / "t.bin"),)], "file string")
    for block in (2, 4, 6, 100):
        assert sorted((r.ordinal, r.n_tokens) for r in K.separator_scan(spark, files, 9, block).collect()) == [(0, 2), (1, 0), (2, 3)]


def test_quality(docs, none):
    assert Q.judge_quality(none).count() == 0
    got = Q.judge_quality(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        w = blank(r.text)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {p for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert not any(r.kept for r in got if r.base_failed)
    prose = " ".join(chr(97 + i % 26) + "ord" + chr(97 + i // 26) for i in range(60))
    fine = docs.where("doc_id = 1").withColumn("text", F.explode(F.array(F.lit(prose), F.lit(prose.upper()), F.lit(prose.replace(" ", "# ")))))
    assert {r.text: r.kept for r in Q.judge_quality(fine).collect()} == {prose: True, prose.upper(): False, prose.replace(" ", "# "): False}
    order = Q.cascade_order(docs, "text", Q.RULES)
    assert sorted(r.name for r in order) == sorted(r.name for r in Q.RULES)
    # a rule that rejects what cheaper ones before it leave comes before one that rejects only what they have
    mixed = fine.sparkSession.createDataFrame([(prose + " " + "! " * (i % 3 * 30),) for i in range(90)], "text string")
    rules = [Q.Rule("none", lambda t, b: F.lit(False) & (b.n_words > 0)), Q.Rule("all", lambda t, b: F.contains(t, F.lit("!"))), Q.Rule("some", lambda t, b: F.regexp_count(t, F.lit("!")) > 40)]
    assert [r.name for r in Q.cascade_order(mixed, "text", rules)][0] != "none"


def test_quality_of_windows_that_share_hash_bits(spark):
    """Two different windows whose packed hash bits are the same, in turns."""
    pairs = [("k1092150 m n", "k2791467 m n"), ("k2407391 m n", "k2813512 m n")]
    texts = [" x ".join(f"{w} {i}" for i, w in enumerate(t)) for a, b in pairs for t in ((a, b, a), (a, b, a, b), (b, a, a, b, b), (a, b))]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    bits = [F.shiftright(F.xxhash64(*map(F.lit, w.split())), Q._PLACE) for p in pairs for w in p]
    h = spark.range(1).select(*[x.alias(str(i)) for i, x in enumerate(bits)]).first()
    assert h[0] == h[1] and h[2] == h[3]
    for r in Q.judge_quality(t).collect():
        w = blank(r.text)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        assert r.n_repeat_words == len({p for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)})


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontaminate(spark, docs, none, block_bytes):
    items = [(1, " ".join(f"W{i}" for i in range(5, 17))), (2, "one, two"), (2, "one, two"), (3, None), (4, "..."), (None, "w40 w41 w42 w43 w44 w45 w46 w47 w48 w49"), (5, " ".join(f"w{i}" for i in range(10, 22)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    got = D.decontaminate(docs, bench, block_bytes=block_bytes).collect()
    assert len(got) == len(ROWS)
    for r in got:
        w, hit, own = alnum(r.text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    own |= windows[tuple(w[k : k + n])]
        c = r.contamination
        assert (c.n_words, c.n_hit) == (len(w), len(hit))
        assert c["items"] == sorted(str(i) for i in own if i is not None)
        assert [x for h in c.hits for x in alnum(r.text[h.start : h.end])] == [w[k] for k in sorted(hit)]
    assert D.decontaminate(none, bench).count() == 0
    assert D.decontaminate(docs, bench.where("false")).where("contamination.n_hit > 0").count() == 0


def test_hilbert_steps_are_neighbours():
    for n, bits in ((2, 3), (3, 3)):
        place, state = S.hilbert_tables(n)
        points = {}
        for p in itertools.product(range(1 << bits), repeat=n):
            h = s = 0
            for b in range(bits - 1, -1, -1):
                cell = sum(((x >> b) & 1) << i for i, x in enumerate(p))
                h, s = (h << n) | place[s * (1 << n) + cell], state[s * (1 << n) + cell]
            points[h] = p
        assert len(points) == 1 << bits * n
        assert all(sum(abs(a - b) for a, b in zip(points[i], points[i + 1])) == 1 for i in range(len(points) - 1))


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_shards(docs, none, shards):
    got = S.hilbert_shards(docs, shards).collect()
    by = collections.Counter(r.shard for r in got)
    assert len(got) == len(ROWS) and max(by.values()) - min(by.get(s, 0) for s in range(shards)) <= 1
    for s in by:
        own = sorted((r.slot, r.curve) for r in got if r.shard == s)
        assert [x for x, _ in own] == list(range(len(own))) and [c for _, c in own] == sorted(c for _, c in own)
    assert all(r["size"] == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
    assert S.hilbert_shards(none, shards).count() == 0


def test_values_alike_in_their_first_bytes(spark):
    """Each of few distinct values has a cell of its own, however long the prefix they share; null has the lowest."""
    names = [None, *[f"common-crawl-{x}" for x in "abc"]]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(names * 3)], "doc_id long, source string")
    got = docs.select("source", S.curve_of(docs, {"s": F.col("source")}).alias("c")).distinct().collect()
    assert sorted(got, key=lambda r: r.c) == sorted(got, key=lambda r: r.source or "") and len({r.c for r in got}) == 4
    many = spark.range(1000).select(F.col("id").alias("v"))
    assert S.cut_points(many, F.col("v"), 4) == [250, 500, 750] and S.cut_points(many.where("v < 0"), F.col("v"), 4) == []


def test_hot_runs(spark, monkeypatch):
    from sitelens.llm import common as C

    monkeypatch.setattr(C, "RUN_ROWS", 5)
    docs = spark.createDataFrame([(i, f"w {i % 3}", "en", "a" if i < 90 else "b") for i in range(100)], "doc_id long, text string, lang string, source string").cache()
    turn = lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest()
    got = sorted(S.hilbert_shards(docs, 7).collect(), key=lambda r: (r.shard, r.slot))
    assert [(r.curve, turn(r)) for r in got] == sorted((r.curve, turn(r)) for r in got)
    taken = M.mix(docs, share=1.2).collect()
    at = {s: 0 for s in "ab"}
    for r in sorted(taken, key=turn):
        words = math.floor(r.target)
        assert r.taken == sum(max(0, min(r["size"], words - at[r.source] - k * r.source_size)) for k in (0, 1))
        at[r.source] += r["size"]


@pytest.mark.parametrize("hot", [None, 7])
def test_repeated_ids_are_split(spark, monkeypatch, hot):
    """Half of all rows have one id, or none; the largest run stays near the usual size, and the results are right."""
    from sitelens.llm import common as C

    monkeypatch.setattr(C, "RUN_ROWS", 50)
    rows = [(hot if i % 2 else 1000 + i, f"w{i} " * (1 + i % 3), "en", "a") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()
    for key, turn in (("curve", ["curve", "sub"]), ("source", ["source", "sub"])):
        counts = docs.select(F.lit(1).alias("curve"), "source", F.when(F.col("doc_id").eqNullSafe(F.lit(hot)), 0).otherwise(F.col("doc_id") % 40).alias("sub"), F.xxhash64("text").alias("h"))
        large = C.split_runs(counts.groupBy(*turn).agg(F.count(F.lit(1)).alias("n")), turn)
        sizes = [r["count"] for r in C.piece_of(counts, large, turn, F.col("h")).groupBy(*turn, "piece").count().collect()]
        assert max(sizes) < 250 and sum(sizes) == 4000
    shards = S.hilbert_shards(docs, 7).collect()
    assert sorted(r.text for r in shards) == sorted(r[1] for r in rows)
    slots = collections.defaultdict(list)
    for r in shards:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    taken = M.mix(docs, share=1.2).collect()
    assert sum(r.taken for r in taken) == math.floor(taken[0].target) and len(taken) == 4000 and max(r.taken - 2 * r["size"] for r in taken) <= 0
    assert sorted(map(str, taken)) == sorted(map(str, M.mix(docs.repartition(5), share=1.2).collect()))


def test_write_shards(spark, docs, tmp_path):
    many = docs.select("*").union(docs.select("*")).union(docs)
    S.write_shards(S.hilbert_shards(many, 3), "file://" + str(tmp_path / "s"), 3, files=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3 * len(ROWS)
    for i in range(3):
        files = sorted((tmp_path / "s" / f"shard={i}").glob("*.parquet"))
        own = [sorted(r.slot for r in spark.read.parquet(str(f)).collect()) for f in files]
        assert 1 < len(files) <= 3 and all(x == list(range(x[0], x[-1] + 1)) for x in own) and sorted(s for x in own for s in x) == list(range(13))


def test_licenses(docs, none):
    got = {(r.doc_id, r.text): r.license for r in L.scan_licenses(docs).collect()}
    a, g = got[11, ROWS[11][1]], got[12, ROWS[12][1]]
    assert (a.n_base, a.base_labels, a.labels) == (3, ["cc-by", "reserved"], ["apache-2.0", "cc-by", "reserved"])
    words = alnum(ROWS[11][1])
    assert (a.first_word, a.last_word) == (words.index("all"), len(words) - 2)
    assert (g.labels, g.score) == (["gpl", "gpl-3.0"], 1.0)
    assert (got[4, None].n_words, got[4, None].labels, got[4, None].score, got[4, None].first_word) == (0, [], 0.0, None)
    assert L.scan_licenses(none).count() == 0


def test_licenses_beside_long_notices(spark):
    """Each short notice is found beside the two long ones, whose words are rarer, though a third of the files hold it."""
    long = [n.text for n in L.NOTICES if n.label in ("bsd", "mit") and 100 < len(n.text) < 200]
    assert len(long) == 2
    rows = [(n.label, ". ".join([*long, n.text])) for n in L.NOTICES]
    rows += [("cc-by-4.0", "Licensed under CC BY 4.0")] * 60 + [("", f"some prose {i}") for i in range(100)]
    got = L.scan_licenses(spark.createDataFrame(rows, "own string, text string")).collect()
    for r in got:
        want = {"bsd", "mit", r.own} if r.text.startswith(long[0]) else {r.own} - {""}
        assert want <= set(r.license.labels) and r.license.score == (1.0 if want else 0.0)


def components(rows, k):
    sets = []
    for i, t, *_ in rows:
        w = blank(low(t))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        n = len(sets[a][1] & sets[b][1])
        if n and 100 * n >= 80 * len(sets[a][1] | sets[b][1]):
            root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted((str(i), len(s), str(least.get(find(a)))) for a, (i, s) in enumerate(sets))


def test_licenses_by_segments(monkeypatch):
    """Notices at every place, cut by segments or not; and a long text of licence words in bounded memory."""
    import random
    import tracemalloc

    r = random.Random(2)
    scan = L.Scanner(L.NOTICES, {}, 10)
    notices = [L._words(n.text) for n in L.NOTICES]
    junk = sorted({w for n in notices for w in n})
    for size in (5, 64, 1000):
        words = [w for _ in range(6) for w in (*r.choices(junk, k=r.randrange(30)), *r.choice(notices)[: r.choice([20, 1000])])]
        monkeypatch.setattr(L, "SEGMENT", 10**9)
        whole = scan.notices_in(words)
        monkeypatch.setattr(L, "SEGMENT", size)
        assert scan.notices_in(words) == whole
    assert whole
    monkeypatch.setattr(L, "SEGMENT", 2000)
    text = b" ".join(r.choices([b"license", b"software", b"copyright", b"permission"], k=200_000))
    tracemalloc.start()
    got = scan(text)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == 200_000 and got[5] == [] and held < 40 << 20


def test_near_duplicates(spark, docs, none):
    for k in (1, 4, 5):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in N.near_duplicates(docs, shingle=k).collect())
        assert got == components(ROWS, k)
    assert N.near_duplicates(none).count() == 0
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "6", "7", "None", "10", "11", "12"])


def test_near_duplicates_in_open_buckets(spark, monkeypatch):
    """Texts of one family with 0.7 to 0.9 between them fill buckets that stars leave open; the blocks lose no link."""
    import random

    r = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(r.randint(0, 5)):
            t[r.randrange(80)] = f"e{r.randrange(400)}"
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "PASSING", 10)
    monkeypatch.setattr(N, "PIVOTS", 1)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == components(rows, 4)


def test_words_that_defeat_polynomial_hashes(spark):
    """The Thue-Morse word and its complement collide under any polynomial modulo 2^64."""
    w = "a"
    while len(w) < 2048:
        w += w.translate(str.maketrans("ab", "ba"))
    rows = [(1, w), (2, w.translate(str.maketrans("ab", "ba"))), (3, f"{w} x y z"), (4, w.upper())]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 1}


def test_densified_bins_estimate_similarity():
    import numpy as np

    s = N.Sketcher(32, 5)
    rng = np.random.default_rng(1)
    for n in (5, 50, 2000):
        rates = []
        for _ in range(60):
            u = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            rates.append((s.bins(u) == s.bins(u[rng.random(len(u)) < 0.8] if n > 5 else np.sort(u[:4]))).mean())
        assert abs(np.mean(rates) - 0.8) < 0.06


def test_chain_of_links_is_one_component(spark):
    e = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1")], "pivot binary, node binary")
    got = {bytes(r.node): bytes(r.label) for r in N.connected(e).collect()}
    assert set(got.values()) == {b"\x00", b"\xf0"} and len(got) == 43


def test_marginals_match_enumeration():
    import numpy as np

    rng = np.random.default_rng(5)
    chain = (1.0, 0.3, 0.6, 1.7, 0.4)
    for n in (1, 2, 7):
        phi = rng.normal(size=n)
        p = X.marginals(phi, np.array([0]), chain)[0]
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(phi[i] for i in range(n) if y[i])) * (chain[4] if y[0] else 1)
            for a, b in zip(y, y[1:]):
                w *= chain[2 * a + b]
            weight[y] = w
        want = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(n)]
        assert np.allclose(p, want)
    phi = rng.normal(size=5000)
    first = np.array([0, 1, 40, 2500])
    whole = X.marginals(phi, first, chain)[0]
    parts = [X.marginals(phi[a:b], np.array([0]), chain)[0] for a, b in zip(first, [*first[1:], 5000])]
    assert np.allclose(whole, np.concatenate(parts))


def test_toxicity_edges(spark, docs, none):
    model = X.Model({"=two": 9.0}, -5.0, (1.0, 0.5, 0.5, 1.0, 1.0), (-4.0, 8.0, 0.0, 0.0))
    got = X.score_toxicity(docs, model).collect()
    assert len(got) == len(ROWS) and got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "size", "toxicity"}
    for r in got:
        assert 0 <= r.toxicity.score <= 1 and r.toxicity.n_tokens == len(alnum(r.text))
        assert [r.text[s.start : s.end] for s in r.toxicity.spans] == [w for w in alnum(r.text) if w == "two"]
    assert X.score_toxicity(none, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.score_toxicity(docs, X.train_toxicity(docs, labels)).where("toxicity.score >= 0.5").count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="no tables")
def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op9_toxicity"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    bad, good = got[got.toxic == 1], got[got.toxic == 0]
    assert (got.predicted == got.toxic).mean() > 0.96 and bad.predicted.mean() > 0.75 and good.predicted.mean() < 0.02


def test_mix(docs, none):
    got = M.mix(docs).collect()
    assert len(got) == len(ROWS) and M.mix(none).count() == 0
    size = collections.Counter()
    for _, t, _, s, *_ in ROWS:
        size[s] += len(blank(t))
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(blank(r.text)) and 0 <= r.taken <= 2 * r["size"] and (r.position is None) == (r.taken == 0)
        taken[r.source] += r.taken
    targets = {r.source: r.target for r in got}
    assert abs(sum(targets.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(t <= 2 * size[s] and abs(taken[s] - t) < 1 for s, t in targets.items())
    again = M.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_mixed_copies_have_their_own_position(spark):
    """A source at twice its size is taken once in the first half of its words and once in the second, by an even schedule."""
    rows = [(i, f"w{i} w w w", s) for i in range(40) for s in ("a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    even = dict(schedules=((1.0, 1.0, 1.0),), weights=(1, 1), share=2.0)
    got = [(r.source, r.doc_id) for r in M.mixed_documents(docs, **even).collect()]
    assert len(got) == 160
    for s in "ab":
        turn = sorted(range(40), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert [i for x, i in got if x == s] == turn + turn


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars int"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]


def test_pipeline_stages_and_empty_table(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    d = docs.drop("Toxicity")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for df, n in ((d, len(ROWS)), (d.where("false"), 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == [*d.columns, *(["shard", "slot"] if name == "sharding" else [])] and out.count() <= n * (2 if name == "mixing" else 1)
    assert hashlib.sha256(b"").hexdigest() == D.decontaminate(d, d.where("false").withColumnRenamed("doc_id", "item_id"), carry=["doc_id"]).select(F.sha2(F.concat_ws(",", "contamination.items"), 256)).first()[0]
