"""Alignment, collocations and byte-level BPE against the libraries and brute force, on odd texts and on whole tables."""

import collections
import hashlib
import itertools
import random
import re

import public_tokenizers as P
import pytest
import tiktoken
from oracle import SF, connect, same, there
from pyspark.sql import functions as F

from sitelens.llm import alignment as A
from sitelens.llm import byte_bpe as B
from sitelens.llm import collocations as C
from sitelens.llm.pieces import Memory, cut_pieces
from sitelens.llm.queries import ORACLES, QUERIES

RANKS = P.path("byte_bpe_50k.tiktoken")
FILES = [P.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
R = random.Random(11)
ODD = [
    None, "", "a", " ", "  x", "x  ", "\n\n", "▁x", "a ▁b", "漢字 仮名 text", "<s> </s> <|endoftext|> <unk> <0x41>", "\x00\x01 \x1c a\x1d b", "é ǘ ﬁ Ａ ½ ² ™ ́x", "tab\tx\n\n y \r\n z", "a\xa0b c　d ​ e \x85 f",
    "a" * 3000, "ab " * 2000, " " * 5000 + "q", "don't we'll it's 'tis I 'd x'", "😀 👍🏽 a😀", "=" * 10_001, "".join(chr(R.randrange(1, 0x3000)) for _ in range(2000)),
    " ".join("".join(chr(R.randrange(33, 0x2FFF)) for _ in range(R.randrange(1, 6))) for _ in range(1000)), "".join(R.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)), "same words", "same words",
]
SCHEMA = "doc_id long, text string, Tokens string, pick int"


@pytest.fixture(scope="module")
def docs(spark):
    """With a null id, repeated rows and columns that clash with made ones."""
    return spark.createDataFrame([(None if i == 3 else i, t, "own", i) for i, t in enumerate(ODD)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(open(RANKS, "rb").read()), special_tokens={})


def ids_of(raw):
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def test_cuts_are_exact():
    for t in ODD:
        assert "".join(cut_pieces(t or "")) == (t or "")
    assert cut_pieces("a b  c\n d e") == ["a", " b  c\n d", " e"]


def test_memory_forgets_all_but_the_latest():
    seen = []

    def encode(pieces):
        seen.extend(pieces)
        return [([len(p) for p in pieces], [ord(c) for p in pieces for c in p])]

    memory = Memory(encode, most=2)
    for texts in ([["ab", "c"], []], [["c", "d"]], [["d", "ab", "d"]], [["c", "ab"]]):
        ids, n = memory.look_up(texts)[0]
        assert "".join(map(chr, ids)) == "".join(p for t in texts for p in t) and n.tolist() == [sum(map(len, t)) for t in texts]
    assert seen.count("d") == 1 and len(memory.at) <= 4


def test_encoding_as_the_library(docs, library):
    got = B.bpe_decode(B.bpe_encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert sorted(r.pick for r in got) == list(range(len(ODD)))
    for r in got:
        text = ODD[r.pick] or ""
        assert ids_of(r.tokens.ids) == library.encode_ordinary(text) and r.tokens.n_tokens == len(r.tokens.ids) // 4 and bytes(r.decoded) == text.encode()
    both = B.bpe_encode(docs, RANKS, P.PATTERN, carry=["pick"], decode=True).collect()
    assert {(r.pick, bytes(r.tokens.ids), bytes(r.tokens.decoded)) for r in both} == {(r.pick, bytes(r.tokens.ids), bytes(r.decoded)) for r in got}
    none = B.bpe_decode(B.bpe_encode(docs.where("false"), RANKS, P.PATTERN), RANKS)
    assert none.count() == 0 and none.columns == ["doc_id", "text", "pick", "tokens", "decoded"]


def test_long_words_by_legs(library, monkeypatch):
    merger = B.Merger(B.read_ranks(open(RANKS, "rb").read()))
    words = [bytes(R.choices(range(256), k=2000)), b"ab" * 3000 + b"a", b" " * 4097, bytes(R.choices(b"the in", k=4000)), "漢字".encode() * 500, b"the"]
    for rows in (B.LEG_ROWS, 10_000):
        monkeypatch.setattr(B, "LEG_ROWS", rows)
        n, ids = merger.contract(words)
        at = 0
        for w, k in zip(words, n.tolist(), strict=True):
            assert ids[at : at + k].tolist() == library._encode_single_piece(w)
            at += k


def test_decoding_by_legs_and_of_odd_ids(spark, monkeypatch):
    speller = B.Speller(B.read_ranks(open(RANKS, "rb").read()))
    monkeypatch.setattr(B, "LEG_TOKENS", 7)
    ids = [[R.randrange(50_000) for _ in range(n)] for n in (0, 30, 1, 6, 7)]
    want = {i: t for t, i in B.read_ranks(open(RANKS, "rb").read()).items()}
    assert speller.decode(ids) == [b"".join(want[i] for i in x) for x in ids]
    d = spark.createDataFrame([(None,), (b"",), ((99_999).to_bytes(4, "little"),)], "ids binary")
    assert [r.decoded for r in B.bpe_decode(d, RANKS, "ids").orderBy(F.col("ids").asc_nulls_first()).collect()] == [None, b"", b""]


def test_vocabularies_are_consistent():
    assert all(B.check_vocabulary(open(P.path(n), "rb").read()) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"))
    lines = open(RANKS, "rb").read().split(b"\n")
    ab = b"YWI= 300000\n"  # "ab" at a rank after tokens that begin with it
    assert not B.check_vocabulary(b"\n".join(x for x in lines if not x.startswith(b"YWI= ")) + b"\n" + ab)


def test_very_long_text(spark, library):
    text = " ".join("".join(R.choices("abcdeé", k=R.randrange(1, 9))) for _ in range(600_000))
    d = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in B.bpe_decode(B.bpe_encode(d, RANKS, P.PATTERN), RANKS).collect()}
    assert ids_of(got[1].tokens.ids) == library.encode_ordinary(text) and bytes(got[1].decoded) == text.encode()
    aligned = {r.doc_id: r.alignment for r in A.align(d, *FILES).collect()}
    assert aligned[1].n_a == len(library.encode_ordinary(" " + text))
    assert aligned[1].groups.count(";") == aligned[1].n_groups - 1


def aligned_by_hand(texts):
    """(n_a, n_b, groups) and the links of each text, from whole texts and sets of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    of_a = A.byte_level_tokens(a.get_vocab())
    of_b = A.piece_tokens([b.id_to_piece(i) for i in range(b.get_piece_size())])
    out = []
    for t in texts:
        raw = (" " + t).encode() if t else b""
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        if b"".join(of_a[i] for i in x) != raw or b"".join(of_b[i] for i in y) != raw:
            x = y = []
        at_a = dict(zip(itertools.accumulate(len(of_a[i]) for i in x), range(len(x)), strict=True))
        at_b = dict(zip(itertools.accumulate(len(of_b[i]) for i in y), range(len(y)), strict=True))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(at_a) & set(at_b)):
            p, q = at_a[end] + 1, at_b[end] + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            links.append((x[p - 1], y[q - 1]))
            i, j = p, q
        out.append((len(x), len(y), groups, links))
    return out


def check_alignment(texts, rows):
    own = aligned_by_hand(texts)
    counts = collections.Counter(x for *_, links in own for x in links)
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for (n_a, n_b, groups, links), got in zip(own, rows, strict=True):
        want = (n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups))
        assert got == want


def test_alignment_of_odd_texts(docs):
    got = sorted(A.align(docs, *FILES).collect(), key=lambda r: r.pick)
    assert [r.Tokens for r in got] == ["own"] * len(ODD)
    check_alignment(ODD, [tuple(r.alignment) for r in got])
    assert A.align(docs.where("false"), *FILES).count() == 0


def test_alignment_over_many_blocks(docs, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_BYTES", 64)
    got = sorted(A.align(docs, *FILES, carry=["pick"], out="x").collect(), key=lambda r: r.pick)
    check_alignment(ODD, [tuple(r.x) for r in got])


def test_shared_cuts():
    import numpy as np

    a, b = np.array([1, 2, 3, 5, 8, 9, 10, 14, 15]), np.array([2, 4, 8, 10, 11, 12, 13, 15])
    assert A.shared_cuts(a, b, [0, 7], [7, 9]).tolist() == [1, 4, 6, 8]
    assert A.shared_cuts(np.array([1]), np.array([1]), [0], [1]).tolist() == [0] and A.shared_cuts(a, b, [], []).tolist() == []


@pytest.mark.skipif(not there(), reason="no tables")
def test_registered_over_whole_tables(spark, library):
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = QUERIES["op13_byte_bpe"](spark, SF).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    pack = lambda ids: b"".join(i.to_bytes(4, "little") for i in ids)
    want = {(i, len(x), sha(pack(x)), sha((t or "").encode())) for i, t in own for x in [library.encode_ordinary(t or "")]}
    assert {tuple(r) for r in got} == want and len(got) == len(own)
    hand = aligned_by_hand([t for _, t in own])
    rows = sorted(QUERIES["op11_alignment"](spark, SF).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.groups_sha256) for r in rows] == [(i, a, b, len(g), sha(";".join(g).encode()) if a else "") for (i, _), (a, b, g, _) in zip(own, hand, strict=True)]
    same(QUERIES["op12_collocations"](spark, SF), ORACLES["op12_collocations"], connect())


def phrases_by_hand(rows, longest=5, least=100, percent=100, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {(lang, g): a for (lang, g), a in f.items() if len(g) > 1 and a >= least}
    longer = collections.Counter()
    for (lang, g), a in cand.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                key = (lang, g[i : i + k])
                longer[key] = max(longer[key], a)
    out = collections.defaultdict(list)
    for (lang, g), a in cand.items():
        if 100 * longer[lang, g] >= percent * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(g).encode(), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    return sorted((lang, i + 1, x[2].decode(), *x[3:]) for lang, own in out.items() for i, x in enumerate(sorted(own)[:top]))


def phrase_rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"top": 7, "percent": 80}, {"longest": 3, "least": 4}, {"longest": 2}])
def test_phrases(spark, monkeypatch, how):
    monkeypatch.setattr(C, "BLOCK_BYTES", 300)
    monkeypatch.setattr(C, "MOST_HOT", 6)
    words = ["a", "b", "B", "c\x01", "c", "dé", "漢", "x" * 40, "a'"]
    text = lambda k: "".join(R.choice(words) + R.choices([" ", "  ", "\t", ". ", ",", "\n", "\x0b", " 　 "], [30, 3, 3, 3, 1, 1, 1, 1])[0] for _ in range(k))
    rows = [(R.choice(["en", "fr", None, "und", ""]), text(R.randrange(60))) for _ in range(120)] + [("en", None), ("en", ""), (None, "   "), ("de", "only once here"), ("en", "z z z z z z z z. " * 9)]
    rows += [("en", text(400))] * 2
    how = {"least": 8, **how}
    d = spark.createDataFrame([(i, *r, "own") for i, r in enumerate(rows)], "doc_id long, lang string, text string, rank string").repartition(4)
    want = phrases_by_hand(rows, **how)
    assert phrase_rows(C.mine_phrases(d, **how)) == want and want


def test_phrases_of_empty_and_rare(spark):
    d = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert C.mine_phrases(d).count() == 0 and C.mine_phrases(d.where("false")).count() == 0
    with pytest.raises(ValueError):
        C.mine_phrases(d, longest=6)


def test_hot_words_are_spread(spark):
    """One pair begins a third of all rows; its rows go to many tasks."""
    text = " ".join(f"hot pair w{i % 700} u{i % 13}." for i in range(20_000))
    d = spark.createDataFrame([("en", text)], "lang string, text string")
    assert phrase_rows(C.mine_phrases(d, least=20)) == phrases_by_hand([("en", text)], least=20)
