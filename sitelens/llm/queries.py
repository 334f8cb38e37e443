"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .byte_bpe import bpe_encode
from .collocations import mine_phrases
from .decontaminate import decontaminate
from .licenses import scan_licenses
from .mixing import mix, training_order
from .near_dedup import near_duplicates
from .quality import judge_quality
from .sharding import hilbert_shards
from .token_counts import count_tokens
from .toxicity import score_toxicity, train_toxicity
from .url_filters import UrlRule, judge_urls
from .warc import read_warc, write_warc

URL_RULES = (
    UrlRule("allow", "org/"),
    UrlRule("block", "example.org/es/"),
    UrlRule("block", "example.org/en/1"),
    UrlRule("allow", "com/fr/"),
    UrlRule("block", "com/de/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_warc(table(spark, sf_dir, "pages"))
    number = lambda c: F.col(c).try_cast("long").alias("page_id" if c == "record_id" else c)
    return read_warc(index).select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


OP1_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS r FROM p),
q AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, 1 + 5 * i, 5))::INT) AS v FROM d)
SELECT page_id, payload_bytes,
  array_to_string(flatten(list_transform(v, lambda x: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> s) & 31), 1)))), '') AS payload_digest,
  CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = r THEN NULL ELSE r END AS refers_to
FROM q
"""


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, carry=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


#: Ranks as sums of 300 terms, of which the last are below 1e-21 of the first.
OP2_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM pages),
r(rule, verdict, h, q) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
links AS (
  SELECT host, dst, dpath, count(*)::DOUBLE AS n FROM (
    SELECT DISTINCT page_id, host, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst,
      regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS dpath
    FROM (SELECT page_id, host, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']?([a-z][a-z0-9+.-]*://[^"''\s>]+)', 1)) AS u FROM p))
  WHERE host <> '' AND dst <> '' AND host <> dst GROUP BY ALL),
u AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM (SELECT host, path FROM p UNION SELECT dst, dpath FROM links) LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY host, path),
known AS (SELECT host, path, 1.0::DOUBLE AS n FROM p UNION ALL SELECT dst, dpath, n FROM links WHERE dst NOT IN (SELECT host FROM p)),
s AS (SELECT host, coalesce(sum(n) FILTER (verdict = 'allow'), 0) / sum(n) AS a, coalesce(sum(n) FILTER (verdict = 'block'), 0) / sum(n) AS b
      FROM known JOIN u USING (host, path) WHERE host <> '' GROUP BY host),
hosts AS (SELECT host, coalesce(a / nullif(sum(a) OVER (), 0), 0) AS good, coalesce(b / nullif(sum(b) OVER (), 0), 0) AS bad FROM s),
near AS (SELECT c.host, arg_max(x.host, length(x.host)) AS parent FROM hosts c JOIN hosts x ON ends_with(c.host, '.' || x.host) GROUP BY c.host),
e AS (SELECT host AS src, dst, sum(n) AS weight FROM links GROUP BY ALL UNION ALL SELECT host, parent, 1 FROM near UNION ALL SELECT parent, host, 1 FROM near),
mv AS (SELECT f, g, sum(t) AS t, sum(d) AS d FROM (
    SELECT src AS f, dst AS g, weight / sum(weight) OVER (PARTITION BY src) AS t, 0.0 AS d FROM e
    UNION ALL SELECT dst, src, 0.0, weight / sum(weight) OVER (PARTITION BY dst) FROM e) GROUP BY f, g),
terms AS (
  SELECT 0 AS k, host, good * 0.15::DOUBLE AS t, bad * 0.15::DOUBLE AS d FROM hosts
  UNION ALL
  SELECT k + 1, g, sum(x.t * mv.t) * 0.85::DOUBLE, sum(x.d * mv.d) * 0.85::DOUBLE FROM terms x JOIN mv ON x.host = f WHERE k < 300 GROUP BY k, g),
ranks AS (SELECT host, sum(t) AS trust, sum(d) AS distrust FROM terms GROUP BY host)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN distrust <= trust * (1 + 1e-9) THEN 'allow' ELSE 'block' END) AS verdict
FROM p JOIN u USING (host, path) LEFT JOIN ranks ON p.host = ranks.host
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), carry=["doc_id"])


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i+1], w[i+2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY doc_id),
b AS (SELECT w.doc_id, t, lines, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(pos.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN pos USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < n_words * 2 OR word_chars > n_words * 12
    OR n_dup_lines * 2 > len(lines)
    OR len(regexp_extract_all(t, '!')) * 5 > n_words
    OR len(regexp_extract_all(t, '[A-Z]')) * 2 > word_chars
    OR len(regexp_extract_all(t, '[0-9\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) * 10 > word_chars * 4
    OR len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) * 10 > len(lines) * 9
    OR len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|\x{2026})[\x20\x09-\x0D]*$'))) * 10 > len(lines) * 3) AS kept
FROM f
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c.n_words.alias("n_words"),
        c.n_hit.alias("n_hit"),
        F.size(c.getField("items")).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c.getField("items")), 256).alias("items_sha256"),
        (c.n_hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH iw AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, g.k, item_id FROM grams g JOIN win USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = hilbert_shards(docs, 24, carry=["doc_id"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("license")
    joined = lambda name: F.array_join(c.getField(name), ",").alias(name)
    found = scan_licenses(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", c.n_words.alias("n_words"), c.n_base.alias("n_base"), c.first_word.alias("first_word"), c.last_word.alias("last_word"), joined("base_labels"), joined("labels"), c.score.alias("score"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = train_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = score_toxicity(docs, model, carry=["doc_id"])
    c = F.col("toxicity")
    offsets = F.transform(c.getField("spans"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return scored.select("doc_id", held_out.alias("held_out"), c.score.alias("score"), (c.score >= 0.5).cast("int").alias("predicted"), offsets.alias("offsets"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = training_order(mix(table(spark, sf_dir, "documents"), carry=["doc_id"]))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", (F.round("position", 6) + 0.0).alias("position"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(doc_id::VARCHAR) AS turn,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, 2 * n AS cap FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS k, 1.5 * sum(n) OVER () - coalesce(sum(cap) OVER o, 0) AS rest,
             sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS w_rest
      FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(rest / w_rest, k) FILTER (rest / w_rest * weight <= cap) AS l FROM p),
t AS (SELECT source, n, rank, least(cap, weight * (SELECT l FROM level)) AS target FROM w),
x AS (SELECT doc_id, size, n, rank, target, floor(target)::BIGINT AS words,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, greatest(0, least(size, words - start)) AS a, greatest(0, least(size, words - start - n::BIGINT)) AS b,
        CASE WHEN words > 0 THEN start::DOUBLE / words ELSE 0 END AS f FROM x)
SELECT doc_id, size, n::BIGINT AS source_size, target, (a + b)::BIGINT AS taken,
  CASE WHEN a > 0 THEN round(CASE rank % 3 WHEN 1 THEN least(f, 1.0)
    WHEN 0 THEN CASE WHEN f <= 0.625 THEN (sqrt(greatest(2.25 - 2 * f, 0)) - 1.5) / -1 ELSE 0.5 + (sqrt(greatest(1 - 2 * (f - 0.625), 0)) - 1) / -1 END
    ELSE CASE WHEN f <= 0.375 THEN sqrt(0.25 + 2 * f) - 0.5 ELSE 0.5 + sqrt(1 + 2 * (f - 0.375)) - 1 END END, 6) + 0.0 END AS position
FROM y
"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    x = F.col("alignment")
    numbers = [x.getField(n).alias(n) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    docs = table(spark, sf_dir, "documents")
    return align(docs, a, b, carry=["doc_id"], groups=digest).select(F.col("doc_id").cast("long").alias("doc_id"), *numbers, x.getField("groups").alias("groups_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, g, count(*) AS a FROM (
    SELECT lang, list_slice(w, i, i + k - 1) AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(w) >= k)) GROUP BY lang, g),
c AS (SELECT * FROM g WHERE a >= 100 AND len(g) > 1),
s AS (SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, (1000::HUGEINT * c.a * n // (x.a::HUGEINT * y.a))::BIGINT AS score, n
  FROM c JOIN range(1, 5) t(k) ON k < len(c.g) JOIN n ON n.lang = c.lang JOIN g x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, k) JOIN g y ON y.lang = c.lang AND y.g = list_slice(c.g, k + 1, len(c.g))),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS nth FROM s),
inner_ AS (SELECT DISTINCT b.lang, list_slice(b.g, i, i + k - 1) AS g, b.a FROM c b, range(1, 5) t(k), range(1, 5) u(i) WHERE k < len(b.g) AND i + k - 1 <= len(b.g)),
held AS (SELECT lang, g, max(a) AS longer FROM inner_ GROUP BY lang, g),
f AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, l, r, n, score FROM b LEFT JOIN held h ON h.lang = b.lang AND h.g = b.g WHERE nth = 1 AND coalesce(100 * longer < 100 * b.a, true)),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM f)
SELECT lang, rank, phrase, a, l, r, n, score FROM t WHERE rank <= 2000
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe_encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, carry=["doc_id"], decode=True)
    x = F.col("tokens")
    digests = F.sha2(x.getField("ids"), 256).alias("ids_sha256"), F.sha2(x.getField("decoded"), 256).alias("decoded_sha256")
    return encoded.select("doc_id", x.getField("n_tokens").alias("n_tokens"), *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_url_filters": op2_url_filters,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_sharding": op6_sharding,
    "op7_licenses": op7_licenses,
    "op8_near_dedup": op8_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_alignment": op11_alignment,
    "op12_collocations": op12_collocations,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op2_url_filters": OP2_SQL,
    "op4_quality": OP4_SQL,
    "op5_decontaminate": OP5_SQL,
    "op10_mixing": OP10_SQL,
    "op12_collocations": OP12_SQL,
}
