"""Addresses written out, found by a pattern that looks at each run of characters once."""

import random
import time

from pyspark.sql import functions as F

from sitelens.operators import contacts as C

#: The rule's pattern as it was published.
PLAIN = r"(?i)([a-zA-Z0-9._%+-]{1,64})\s*(?:\[at\]|\(at\)|\sAT\s|@)\s*([a-zA-Z0-9.-]+)\s*(?:\[dot\]|\(dot\)|\sDOT\s|\.)\s*([a-zA-Z]{2,})"


def test_written_out_as_the_plain_pattern(spark):
    """The same addresses as the plain pattern finds on texts of what matters to it, also after a match's end and before long runs."""
    r = random.Random(7)
    piece = ["a", "b1", "at", "AT", "dot", " ", "  ", "\n", "[at]", "(at)", "[AT]", "[dot]", "(DOT)", "@", "@", ".", "..", "-", "_", "%", "é", "ſ", "[", "x" * 40, "y" * 70, "co", "org", " at ", " dot "]
    d = spark.createDataFrame([("".join(r.choice(piece) for _ in range(r.randint(1, 40))),) for _ in range(20_000)], "t string")
    parts = lambda p, t, i: F.regexp_extract_all(t, F.lit(p), F.lit(i))
    each = F.transform(parts(C.OBFUSCATED, "t", 0), lambda m: F.array(*[F.regexp_extract(m, C.OBFUSCATED, i) for i in (1, 2, 3)]))
    plain = F.transform(F.arrays_zip(*[parts(PLAIN, "t", i).alias(n) for i, n in ((1, "l"), (2, "d"), (3, "t"))]), lambda x: F.array(x.l, x.d, x.t))
    row = d.select(each.alias("a"), plain.alias("b")).agg(F.sum(F.size("b")).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("odd")).first()
    assert row.n > 1_000 and row.odd == 0


def test_written_out_once_a_run(spark):
    """Long words are looked at once, not from each of their characters."""
    d = spark.createDataFrame([(1, ("x" * 60 + "  ") * 5_000 + "ann [at] site.org")], "k int, t string").cache()
    d.count()

    def seconds(df):
        start = time.perf_counter()
        got = df.collect()
        return time.perf_counter() - start, got

    plain = d.select(F.regexp_extract_all("t", F.lit(PLAIN), F.lit(1)).alias("a"))
    mine = C.emails_deobfuscated(d, F.col("t"), "k")
    (_, _), (_, got) = seconds(plain), seconds(mine)
    assert [r.normalized_email for r in got] == ["ann@site.org"]
    assert min(seconds(mine)[0] for _ in range(3)) < seconds(plain)[0] / 3
