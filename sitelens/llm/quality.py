"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base counts are computed for every text. The verdict then runs through a list of rules; each rule's cost and rejection
rate are measured on a sample, and rules are tried in order of rejection per cost, so most bad texts meet few rules.
The order changes only the work: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, BLANKS, col, cut, discard, let

SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which rules are measured, and evaluations that are timed; they settle the rules' order and nothing else.
SAMPLE_ROWS, TIMED_ROWS = 500, 10_000


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps (text, base counts struct) to a boolean column that is true for a bad text."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANK_CHARS, "") != "")


def _share(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that ``pattern`` matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


#: Thresholds in whole numbers, so that any engine decides alike. Texts that reach a rule have 50 words or more.
RULES = (
    Rule("symbols", lambda text, b: b.n_symbols * 10 > b.n_words),
    Rule("word_length", lambda text, b: (b.word_chars < b.n_words * 2) | (b.word_chars > b.n_words * 12)),
    Rule("duplicate_lines", lambda text, b: b.n_dup_lines * 2 > F.size(_lines(text))),
    Rule("exclamations", lambda text, b: (F.length(text) - F.length(F.translate(text, "!", ""))) * 5 > b.n_words),
    Rule("capitals", lambda text, b: _share(text, "[A-Z]") * 2 > b.word_chars),
    Rule("letters", lambda text, b: _share(text, r"[0-9\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]") * 10 > b.word_chars * 4),
    Rule("bullets", lambda text, b: F.size(F.filter(_lines(text), lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))) * 10 > F.size(_lines(text)) * 9),
    Rule("ellipses", lambda text, b: F.size(F.filter(_lines(text), lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))) * 10 > F.size(_lines(text)) * 3),
)


#: Low bits that hold a window's place beside the high bits of its hash.
_PLACE = 28


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    A window is one number: hash bits, then its place. Sorted, windows of equal bits are neighbours. If neighbours of
    equal bits are always equal in words too, all of them repeat. Else different windows share bits and may lie between
    equal ones, so all windows that share bits are sorted by their words. Texts in which no hash repeats are done after one look.
    """
    at = lambda a, i: F.get(a, i)
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(at(words, i), at(words, i + 1), at(words, i + 2)))
    mask = F.lit((1 << _PLACE) - 1)

    def places(h: Column) -> Column:
        packed = F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, _PLACE), _PLACE).bitwiseOR(i.cast("long")))
        place = lambda x: x.bitwiseAND(mask).cast("int")

        true = lambda c: F.coalesce(c, F.lit(False))
        bits = lambda x, y: F.shiftright(x, _PLACE) == F.shiftright(y, _PLACE)
        own = lambda x, y, k: at(words, place(x) + k) == at(words, place(y) + k)

        def by_words(shared: Column) -> Column:
            window = lambda x: F.struct(*[at(words, place(x) + k).alias(f"w{k}") for k in range(3)])
            listed = F.sort_array(F.transform(shared, lambda x: F.struct(window(x).alias("w"), x.alias("x"))))
            equal = lambda a, b: true(a.getField("w") == b.getField("w"))
            return F.transform(let(listed, lambda s: F.filter(s, lambda a, i: equal(a, at(s, i - 1)) | equal(a, at(s, i + 1)))), lambda a: a.getField("x"))

        def repeats(shared: Column) -> Column:
            other = F.filter(shared, lambda x, i: true(bits(x, at(shared, i + 1)) & ~(own(x, at(shared, i + 1), 0) & own(x, at(shared, i + 1), 1) & own(x, at(shared, i + 1), 2))))
            return F.when(F.size(other) == 0, shared).otherwise(by_words(shared))

        shared = let(F.sort_array(packed), lambda s: F.filter(s, lambda x, i: true(bits(x, at(s, i - 1))) | true(bits(x, at(s, i + 1)))))
        twice = let(shared, repeats)
        return F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(place(x), place(x) + 1, place(x) + 2))))

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(F.size(places(h))))
    return F.when(F.size(words) < 3, 0).otherwise(counted)


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    dup = let(_lines(text), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, BLANK_CHARS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        ),
    )


def base_fails(b: Column, min_words: int) -> Column:
    return (b.n_words < min_words) | (b.n_repeat_words * 100 > b.n_words * 50)


def cascade_order(docs: DataFrame, text_col: str, rules: Sequence[Rule], min_words: int = 50, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per cost on a sample of about ``sample_rows`` rows; an empty sample keeps the given order.

    Only rows that reach the rules count. A rule's cost is the time of TIMED_ROWS evaluations over that of a job that
    reads the same rows, the less of two measurements. Each rule's rejections count rows that no earlier rule rejects.
    """
    n = docs.count()
    if not n:
        return list(rules)
    text = F.coalesce(col(text_col), F.lit(""))
    sample = docs.select(text.alias("t")).sample(min(1.0, sample_rows / n), seed=7).select("t", base_counts(F.col("t")).alias("b"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    sample = cut(sample.where(~base_fails(F.col("b"), min_words)).repartition(cores), "sample")
    t, b = F.col("t"), F.col("b")
    rows = sample.select(*[r.rejects(t, b).alias(str(i)) for i, r in enumerate(rules)]).collect()
    if not rows:
        return list(rules)
    many = sample.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(max(1, -(-TIMED_ROWS // len(rows)))))))

    def seconds(x: Column) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            many.select((x & (F.col("turn") > 0)).alias("x")).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    idle = seconds((F.octet_length(t) >= 0) & (b.n_words >= 0))
    cost = [max(seconds(r.rejects(t, b)) - idle, 1e-3) for r in rules]
    discard(sample)
    left, order = list(range(len(rules))), []
    while left:
        best = max(left, key=lambda i: (sum(bool(r[i]) for r in rows) / cost[i], -cost[i]))
        rows = [r for r in rows if not r[best]]
        left.remove(best)
        order.append(rules[best])
    return order


def judge_quality(
    docs: DataFrame,
    text_col: str = "text",
    rules: Sequence[Rule] = RULES,
    min_words: int = 50,
    carry: Sequence[str] | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The ``carry`` columns (default: all) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Words are runs between ASCII blanks, lines parts between newlines with a word. ``base_failed``: fewer than
    ``min_words`` words, or more than half of them in 3-word windows that repeat in the text. ``kept``: not base_failed
    and rejected by no rule. Null texts count as empty: all counts 0, base_failed. Texts are judged whole, repeated rows
    alike; an empty table gives an empty one. Result columns replace input columns of the same names. No shuffle.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    keep = [c for c in (carry if carry is not None else docs.columns) if c.lower() not in made]
    ordered = cascade_order(docs, text_col, rules, min_words, sample_rows)
    text = F.coalesce(col(text_col), F.lit(""))

    def verdict(b: Column) -> Column:
        failed = base_fails(b, min_words)
        kept = F.when(failed, False)
        for r in ordered:
            kept = kept.when(r.rejects(text, b), False)
        return F.struct(*[b.getField(c).alias(c) for c in made[:5]], failed.alias("base_failed"), kept.otherwise(True).alias("kept"))

    judged = docs.select(F.struct(*[col(c).alias(c) for c in keep]).alias("row"), let(base_counts(text), verdict).alias("q"))
    return judged.select(*[F.col("row").getField(c).alias(c) for c in keep], *[F.col("q").getField(c).alias(c) for c in made])
