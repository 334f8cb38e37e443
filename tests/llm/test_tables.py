"""Registered queries and the pipeline against brute force over the driver's tables."""

import collections
import hashlib
import itertools
import math
import zlib

import pytest
from oracle import SF, there
from test_llm import alnum, blank, low

import corpus_pipeline
from sitelens.llm import licenses as L
from sitelens.llm import mixing as M
from sitelens.llm import token_counts as K
from sitelens.llm import toxicity as X
from sitelens.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not there(), reason="no tables")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def groups(texts, k, share=80):
    """(doc_id, set size, least id reachable) by every pair that has a shingle in common."""
    sets, where, both = {}, collections.defaultdict(list), collections.Counter()
    for i, t in texts:
        w = blank(low(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        for s in sets[i]:
            where[s].append(i)
    for own in where.values():
        both.update(itertools.combinations(sorted(own), 2))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {(i, len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_dedup(spark, sf):
    d = f"/root/testdata/{sf}"
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op8_near_dedup"](spark, d).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == groups(own, 4) and len(got) == len(own)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_token_counts(spark, texts):
    enc, _ = K.load_encoding(K.vocabulary(K.TOKENIZER))
    want = sorted((i, len(enc.encode_ordinary(t or ""))) for i, t in texts)
    assert sorted((r.doc_id, r.n_tokens) for r in QUERIES["op3_token_counts"](spark, SF).collect()) == want


def test_sharding(spark, texts):
    got = QUERIES["op6_sharding"](spark, SF).collect()
    raw = {i: (t or "").encode() for i, t in texts}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(i, len(b) + 8, zlib.crc32(b)) for i, b in raw.items()}
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append((r.slot, r.curve))
    assert len(got) == len(texts) and set(by) == set(range(24))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    along = [c for s in range(24) for _, c in sorted(by[s])]
    assert all([x for x, _ in sorted(v)] == list(range(len(v))) for v in by.values()) and along == sorted(along)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def plain_licenses(words, notices, idf, df, files):
    """Labels and best score by laying each notice at every place of the text where one of its rare words stands exactly and two do nearly."""
    found, slack = {}, L.SLACK
    for label, model, keys in notices:
        rarest = sorted(set(model), key=lambda w: (-idf[w], w))
        rare = {w for w in model if w in rarest[:2] or df[w] <= L.COMMON * files}
        whole = sum(idf[w] for w in model)
        places = {w: [i for i, x in enumerate(words) if x == w] for w in set(model)}
        for shift in range(-len(model), len(words)):
            votes = {(w, i - j - shift) for j, w in enumerate(model) if w in rare for i in places[w]}
            if all(d for _, d in votes) or len({w for w, d in votes if abs(d) <= slack}) < min(2, len(rare)):
                continue
            near = words[max(0, shift - slack) : shift + len(model) + slack]
            if all(any(near[i : i + len(k)] == k for i in range(len(near))) for k in keys):
                got = sum(idf[w] for j, w in enumerate(model) if any(abs(i - j - shift) <= slack for i in places[w]))
                if got / whole >= L.LEAST:
                    found[label] = max(found.get(label, 0.0), min(1.0, got / whole))
    return found


def test_licenses(spark, texts):
    """The registered query, and texts that hold each notice, whole, with words put in, cut, and all notices together."""
    every = ". ".join(n.text for n in L.NOTICES)
    made = [every, every.replace(" the ", " the very ")]
    made += [f"prose {n.label} " + t for n in L.NOTICES for t in (n.text, n.text.replace(" ", " x ", 2), n.text[: len(n.text) // 2], " ".join(n.text.split()[::-1]))]
    own = [*texts, *enumerate(made, 10**6)]
    files = len(own)
    df = collections.Counter(w for _, t in own for w in set(alnum(t)))
    notices = [(n.label, alnum(n.text), [alnum(k) for k in n.keys]) for n in L.NOTICES]
    idf = {w: math.log((files + 1) / (df[w] + 1)) + 0.1 for _, m, _ in notices for w in m}
    docs = spark.createDataFrame(own, "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan_licenses(docs, carry=["doc_id"]).collect()}
    plain = {r.doc_id: r for r in QUERIES["op7_licenses"](spark, SF).collect()}
    phrases = [(p.split(), label) for p, label in L.PHRASES]
    assert got[10**6].license.labels == sorted({n.label for n in L.NOTICES} | {"cc-by", "gpl"})
    for i, t in own:
        w, r = alnum(t), got[i].license
        at = [(j, label) for p, label in phrases for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
        more = plain_licenses(w, notices, idf, df, files)
        base = sorted({label for _, label in at})
        starts = [j for j, _ in at]
        want = (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == want
        assert r.base_labels == base and r.labels == sorted({*base, *more})
        assert abs(r.score - max([L.BASE_SCORE if base else 0.0, *more.values()])) < 1e-9
        if i in plain:
            assert (plain[i].n_words, plain[i].n_base, plain[i].first_word, plain[i].last_word, plain[i].base_labels) == (*want, ",".join(base))


def plain_score(model, text):
    """The score of a text by forward and backward messages token by token."""
    phi = [max(-X.LIMIT, min(X.LIMIT, model.bias + sum(model.weights.get(f, 0.0) for f in X.features(w.encode())))) for w in alnum(text)]
    a00, a01, a10, a11, s = model.chain
    p = []
    if phi:
        ahead = [(1.0, s * math.exp(phi[0]))]
        for x in phi[1:]:
            u, v = ahead[-1]
            u, v = u * a00 + v * a10, (u * a01 + v * a11) * math.exp(x)
            ahead.append((u / (u + v), v / (u + v)))
        back = [(1.0, 1.0)]
        for x in phi[:0:-1]:
            u, v = back[-1]
            e = v * math.exp(x)
            u, v = a00 * u + a01 * e, a10 * u + a11 * e
            back.append((u / (u + v), v / (u + v)))
        p = [b * d / (a * c + b * d) for (a, b), (c, d) in zip(ahead, reversed(back))]
    row = (1.0, max(p), math.log1p(sum(p)), math.log1p(1000 * sum(p) / len(p))) if p else (1.0, 0.0, 0.0, 0.0)
    return 1 / (1 + math.exp(-max(-30, min(30, sum(x * y for x, y in zip(row, model.logit))))))


def test_toxicity(spark, texts):
    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = X.train_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels.where(~labels.doc_id.isin(*held)))
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, SF).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        assert abs(got[i].score - plain_score(model, t)) < 1e-9
        assert (got[i].held_out, got[i].predicted) == (i in held, int(got[i].score >= 0.5))


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i} " + "x" * (i % 3 * 50)) for i in range(400)] + [(1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(7)] + [(None, 1), (5, None), (1, 0)], "doc_id long, toxic int")
    rows, share = X.training_rows(docs, labels, "doc_id", "text", "toxic", 10, 20, 64)
    assert collections.Counter(y for _, y in rows) == {1: 10, 0: 20} and share == 3 / 7
    assert all(len(t) <= 64 for t, _ in rows)


def plain_mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """Texts with the copies the mix takes, from (doc_id, text, source) rows."""
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(blank(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, total = {}, share * sum(size.values())
    free = list(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > most * size[s]]
        target.update({s: most * size[s] for s in over} if over else {s: weight[s] * level for s in free})
        free = [s for s in free if s not in target] if over else []
    out = collections.Counter()
    for s in order:
        at, own = 0, sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())
        for _ in range(most):
            for i, t, _s in own:
                if at < math.floor(target[s]) and blank(t):
                    out[i] += 1
                at += len(blank(t))
    return out


def test_pipeline(spark):
    """``run`` against the stages by brute force; the toxicity model is the stage's own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = X.train_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {i: r for i, r in rows.items() if plain_score(model, r.text) < corpus_pipeline.TOXIC}
    rows = {i: rows[i] for i, _, least in groups([(i, r.text) for i, r in rows.items()], 5) if i == least}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = alnum(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    holds = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    rows = {i: r for i, r in rows.items() if not holds(alnum(r.text))}
    want = plain_mix([(i, r.text, r.source) for i, r in rows.items()])
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r.doc_id for r in got) == want
    assert all(r.text == rows[r.doc_id].text and r.lang == rows[r.doc_id].lang for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    held = M.mix(docs.where(docs.doc_id.isin(*rows))).collect()
    assert {r.doc_id: r.copies for r in held if r.copies} == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_extra_columns_that_clash(spark, tmp_path, name):
    """Every query gives the same rows when its tables have more columns, named as the operators name theirs."""
    clash = "node key size row turn n license made rank source_size text_of seen Score id archive label h block".split()
    for t in ("documents", "pages", "benchmark", "labels"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        few = df.withColumns({c: df[df.columns[0]].cast("string") for c in clash if c.lower() not in {x.lower() for x in df.columns}})
        few.write.parquet(str(tmp_path / f"{t}.parquet"))
    assert sorted(map(str, QUERIES[name](spark, str(tmp_path)).drop("score").collect())) == sorted(map(str, QUERIES[name](spark, SF).drop("score").collect()))
