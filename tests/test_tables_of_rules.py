"""Snapshots, host rules as tables, the term automaton, robots rules, histories and sweeps on inline rows."""

import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from sitelens.functions import rules as H
from sitelens.functions import urls as U
from sitelens.functions.lists import SUFFIXES
from sitelens.operators import contacts as C
from sitelens.operators import evaluate as E
from sitelens.operators import reports as R
from sitelens.operators import score_v2 as V2
from sitelens.sources import snapshots as S

SITES = "canonical_key string, name string, description string, homepage_url string"


def sites(spark, *rows):
    return spark.createDataFrame(rows, SITES)


def stored(spark, folder):
    return sorted(map(tuple, S.read_snapshot(spark, folder, SITES).collect()))


def test_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    assert stored(spark, folder) == [] and S.versions(spark, folder) == []
    a = sites(spark, ("a.com", "", None, "h"), ("b.com", "B", "d", "h"))
    assert S.store_websites(a, folder, "job1") == 1
    reader = S.read_snapshot(spark, folder, SITES)
    assert S.store_websites(sites(spark, ("a.com", "A", "x", "z"), ("c.com", "C", None, "h")), folder, "job2") == 2
    assert sorted(r.canonical_key for r in reader.collect()) == ["a.com", "b.com"]  # an open reader keeps its version
    want = [("a.com", "A", "x", "h"), ("b.com", "B", "d", "h"), ("c.com", "C", None, "h")]
    assert stored(spark, folder) == want
    assert S.store_websites(sites(spark, ("d.com", "D", None, "h")), folder, "job2") == 2 and stored(spark, folder) == want
    assert S.read_snapshot(spark, folder, SITES, 1).count() == 2
    with pytest.raises(ValueError):
        S.read_snapshot(spark, folder, SITES, 9)


@pytest.mark.parametrize("lost", ["data", "commit"])
def test_crash_before_the_commit(spark, tmp_path, monkeypatch, lost):
    folder = f"file://{tmp_path}/t"
    S.store_websites(sites(spark, ("a.com", "A", None, "h")), folder, "job1")
    write, commit = DataFrameWriter.parquet, DataFrameWriter.json

    def fails(self, path, *args, **kwargs):
        write(self, path, *args, **kwargs)
        raise OSError("lost after the data")

    def never(self, path, *args, **kwargs):
        raise OSError("lost before the commit")

    monkeypatch.setattr(DataFrameWriter, "parquet", fails) if lost == "data" else monkeypatch.setattr(DataFrameWriter, "json", never)
    more = sites(spark, ("b.com", "B", None, "h"))
    with pytest.raises(OSError):
        S.store_websites(more, folder, "job2")
    assert stored(spark, folder) == [("a.com", "A", None, "h")]
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    monkeypatch.setattr(DataFrameWriter, "json", commit)
    assert S.store_websites(more, folder, "job2") == 2 and S.store_websites(more, folder, "job2") == 2
    assert [r[0] for r in stored(spark, folder)] == ["a.com", "b.com"]


def test_half_a_commit_is_not_read(spark, tmp_path):
    folder = f"{tmp_path}/t"
    S.store_websites(sites(spark, ("a.com", "A", None, "h")), folder)
    os.makedirs(f"{folder}/commits/version=2/_temporary/0")
    with open(f"{folder}/commits/version=2/_temporary/0/part.json", "w") as f:
        f.write(json.dumps({"data": "nowhere"}))
    assert [v.number for v in S.versions(spark, folder)] == [1] and len(stored(spark, folder)) == 1
    with pytest.raises(PySparkException):  # another writer is at version 2
        S.store_websites(sites(spark, ("b.com", "B", None, "h")), folder)
    assert len(stored(spark, folder)) == 1


def test_stored_sources_and_contacts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "q", 2), ("a", "q", 1), ("b", "q", 3)], "site string, query string, seq int")
    folder = f"file://{tmp_path}/s"
    for _ in range(2):
        S.store_new(rows, folder, ["site", "query"])
    assert sorted(map(tuple, S.read_snapshot(spark, folder, rows.schema).collect())) == [("a", "q", 1), ("b", "q", 3)]
    contacts = lambda *r: spark.createDataFrame(r, "contact_key string, confidence double, note string")
    folder = f"file://{tmp_path}/c"
    S.store_contacts(contacts(("x", 0.5, "old"), ("y", 0.5, "old")), folder)
    new = contacts(("x", 0.5, "new"), ("y", 0.6, "new"), ("z", 0.1, "new"))
    assert tuple(S.contact_changes(spark, folder, new).first()) == (1, 2)
    S.store_contacts(new, folder)
    assert sorted((r.contact_key, r.note) for r in S.read_snapshot(spark, folder, new.schema).collect()) == [("x", "old"), ("y", "new"), ("z", "new")]


def test_suffix_rules_equal_literals(spark):
    hosts = ["a.com", "x.a.co.uk", "city.kobe.jp", "a.b.kobe.jp", "kobe.jp", "www.ck", "a.ck", "b.a.ck", "com", "", "a..com", "x.y.gen.nz", "localhost", "q.w.e.r.t.sch.uk"]
    rules = [*SUFFIXES, "com", "uk", "co.uk", "jp", "ck", "nz", "// comment", " ", "COM"]
    d = spark.createDataFrame([(h,) for h in [*hosts, *hosts, None]], "host string")
    table = spark.createDataFrame([(r,) for r in rules], "rule string")
    literal = [r for r in rules if r.strip() and not r.startswith("//") and r != "COM"]
    got = H.with_suffixes(d, F.col("host"), table).select("host", F.coalesce("suffix_labels", F.lit(0)).alias("n"), "registered_domain")
    want = d.select("host", F.coalesce(U.suffix_size(F.col("host"), literal), F.lit(0)).alias("n"), U.registered_domain(F.col("host"), literal).alias("registered_domain"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString()) if hasattr(df, "_jdf") else 0


def test_large_rule_tables_do_not_grow_the_plan(spark):
    hosts = spark.range(5000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".s"), F.col("id") % 100, F.lit(".tld")).alias("host"))
    small, large = (spark.range(n).select(F.concat(F.lit("s"), F.col("id"), F.lit(".tld")).alias("rule")) for n in (10, 10_000))
    sizes = [plan_size(H.with_suffixes(hosts, F.col("host"), r)) for r in (small, large)]
    assert abs(sizes[0] - sizes[1]) < 100
    assert H.with_suffixes(hosts, F.col("host"), large).where("suffix_labels = 2").count() == 5000
    blocked = spark.range(1_000_000).select(F.concat(F.lit("s"), F.col("id"), F.lit(".tld")).alias("host"), F.lit("blocked_spam").alias("reason"))
    assert H.with_blocks(hosts, F.col("host"), blocked).where("block_reason = 'blocked_spam'").count() == 5000


def test_longest_block_holds(spark):
    blocked = spark.createDataFrame([("a.com", "r1"), ("x.a.com", "r2"), ("x.a.com", "r0")], "host string, reason string")
    d = spark.createDataFrame([("A.com", 1), ("y.x.a.com", 2), ("ba.com", 3), (None, 4)], "h string, block int")
    assert {r.block: r.block_reason for r in H.with_blocks(d, F.col("h"), blocked).collect()} == {1: "r1", 2: "r0", 3: None, 4: None}


def test_automaton_equals_substrings(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 4)))
    terms = sorted({" ".join(word() for _ in range(r.randrange(1, 3))) for _ in range(400)})
    vocabulary = {"k1": {"en": terms[::2], "fr": terms[:5]}, "k2": {"en": terms[1::2] + terms[:3]}}
    texts = [[" ".join(word() for _ in range(8)) for _ in range(r.randrange(3))] for _ in range(50)] + [None, [None, "a"]]
    d = spark.createDataFrame([(i, t, [word()]) for i, t in enumerate(texts)], "i int, t array<string>, u array<string>")
    uses = {"first": (("t",), ("k1",)), "both": (("t", "u"), ("k1", "k2"))}
    for row in d.select("*", V2.match_kinds({"t": F.col("t"), "u": F.col("u")}, uses, vocabulary).alias("m")).collect():
        held = lambda own, ts: {x for x in own for t in ts or [] if t and x in t}
        k1, k2 = {x for v in vocabulary["k1"].values() for x in v}, {x for v in vocabulary["k2"].values() for x in v}
        want = {("first", x) for x in held(k1, row.t)} | {("both", x) for x in held(k1 | k2, [*(row.t or []), *row.u])}
        assert {(m.kind, m.term) for m in row.m} == want and len(row.m) == len(want)


def test_ten_thousand_terms_in_a_plan_of_constant_size(spark):
    d = spark.createDataFrame([(["term 77 and term 9999"],)], "t array<string>")
    sizes = []
    for n in (10, 10_000):
        m = d.select(F.explode(V2.match_kinds({"t": F.col("t")}, {"k": (("t",), ("v",))}, {"v": {"en": [f"term {i}" for i in range(n)]}})).alias("m"))
        sizes.append(plan_size(m))
    assert sizes[0] == sizes[1]
    assert sorted(r.m.term for r in m.collect()) == ["term 7", "term 77", "term 9", "term 99", "term 999", "term 9999"]


def test_robots_rules_by_prefix(spark):
    r = random.Random(1)
    path = lambda: "/" + "".join(r.choice("ab/") for _ in range(r.randrange(8)))
    rules = [("h", i, r.random() < 0.5, path()) for i in range(300)] + [("g", 0, False, ""), ("g", 1, False, "/x")]
    urls = sorted({("h", path()) for _ in range(500)} | {("g", "/y"), ("g", "/x/y"), ("none", "/")})
    d = spark.createDataFrame(rules, "host string, seq int, allow boolean, path string"), spark.createDataFrame(urls, "host string, path string")
    want = {}
    for host, p in urls:
        for own, _, allow, prefix in rules:
            if own == host and prefix and p.startswith(prefix):
                want[host, p] = allow
                break
    for part_rows in (1_000_000, 20):
        got = C.first_rules(d[1], d[0], part_rows).collect()
        assert {(x.host, x.path): x.allow for x in got} == want and len(got) == len(want)


def test_histories_are_bounded_and_spread(spark):
    one = spark.createDataFrame([("a",), ("b",)], "site string")
    rows = spark.range(5000).select(F.when(F.col("id") < 4990, "a").otherwise("c").alias("site"), F.col("id").alias("n"), F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("at"))
    got = {r.site: r for r in R.website_detail(one, {"h": (rows, [-F.col("at"), F.col("n")], 120), "e": (rows.where("false"), [F.col("n")], 3)}, parts=8).collect()}
    want = sorted((r for r in rows.where("site = 'a'").collect()), key=lambda r: (-r["at"] if r["at"] is not None else float("inf"), r.n))[:120]
    assert [(x.n, x["at"]) for x in got["a"].h] == [(r.n, r["at"]) for r in want] and got["a"].e == [] and got["b"].h == [] and set(got) == {"a", "b"}


@pytest.mark.parametrize("policy", ["5", "5B", "5C"])
def test_sweep_by_cells(spark, policy):
    r = random.Random(7)
    labels = ("gaming_media", "not_gaming_media", "uncertain")
    rows = [(r.choice(labels), r.choice([None, None, "casino", E.IDENTITY_RULE]), r.choice([0.5, 1.0, None]), r.randrange(40, 95), r.randrange(10, 26), r.randrange(8, 20), r.randrange(12), r.randrange(6)) for _ in range(400)]
    preds = spark.createDataFrame(rows, "expected_label string, hard_rule string, hard_rejection_confidence double, total_score int, gaming_score int, media_score int, market_score int, technical_score int")
    got = {x.config_id: x for x in E.grid_sweep(preds, E.GRIDS[policy], policy).collect()}
    assert len(got) == {"5": 108, "5B": 25, "5C": 10}[policy]
    cells = E.score_cells(preds.union(preds), E.GRIDS[policy])
    assert cells.count() == E.score_cells(preds, E.GRIDS[policy]).count() and cells.agg(F.sum("n")).first()[0] == 800
    for i, x in enumerate(E.GRIDS[policy]):
        n = dict.fromkeys(("tp", "fp", "fn", "tn", "abstain"), 0)
        for label, rule, conf, total, g, m, k, t in rows:
            core = total >= x["verified_threshold"] and g >= x["gaming_minimum"] and m >= x["media_minimum"] and t >= x["technical_minimum"]
            low = total < x["uncertain_threshold"] and t >= x["technical_minimum"]
            if policy == "5C":
                if label == "uncertain":
                    continue
                no = (rule and rule != E.IDENTITY_RULE) or (x["high_conf_neg"] and conf == 1.0 and g <= 20 and m <= 15)
                status = "rejected" if no else "verified" if core else "rejected" if low else "uncertain"
                n["abstain" if status == "uncertain" else {"verifiedT": "tp", "verifiedF": "fp", "rejectedT": "fn", "rejectedF": "tn"}[status + str(label == labels[0])[0]]] += 1
                continue
            full = core and k >= x["market_minimum"]
            status = "rejected" if rule else ("verified" if full else "uncertain") if total >= x["verified_threshold"] else "rejected" if low else "uncertain"
            hit = not rule and (full if policy == "5" else core)
            n["abstain"] += status == "uncertain"
            n[("tp" if hit else "fn") if label == labels[0] else ("fp" if hit else "tn")] += 1
        y = got[i + 1]
        assert (y.tp, y.fp, y.fn, y.tn, y.abstentions) == (n["tp"], n["fp"], n["fn"], n["tn"], n["abstain"])
