"""URL filter: rules, and character language models of accepted and rejected URLs. DataFrame functions only.

A URL that a rule fits gets the rule's verdict, the longest rule's if several do. Of the URLs with such a verdict, all
but one in HELD_OUT (by a hash of the URL) teach two variable-order Markov models over a fixed alphabet (letters, one
digit class, punctuation, anything else). A symbol's probability after the class of its third last, its second
last and its last symbol is interpolated (Witten-Bell) with that after the last two, the last one, none, and with
a uniform one: the longer the context that was seen, the more of it counts.

All other URLs are judged by the difference of the two log-likelihoods divided by the number of symbols. Its threshold
is set on the URLs held out: of THRESHOLDS values in steps of STEP the one with the least sum of both error
rates, the most central one if several have it; 0 if the held-out URLs lack one of the verdicts.

The models are one number for each index of four symbols, `SIZE` numbers whatever the input, counted by a partially
aggregated group-by. They reach the rows as a scalar subquery; a URL is scored by one fold over its symbols, within
its row and in linear time, and nothing of the rows is shuffled.

Defined cases: a null URL, or one without `://`, has an empty host and path and no rule, and null and empty ones have
score 0; without rule verdicts of both kinds all scores and the threshold are 0; a score at the threshold is a tie and
allowed; long URLs are read whole; repeated rows are judged each; empty tables give no rows; other columns, of whatever
name, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import cut

#: Rules (fixed values): host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Symbols 1 to 38; 0 is any other character and the last one the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_:?=&%#~"
A = len(ALPHABET) + 2
START = A - 1
#: Classes of the third last symbol, by their members; class 0 has all others.
CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "0", "/", ".-_")
#: Numbers in the model, and how many grams of each order from none to three symbols of context there are.
SIZE = (len(CLASSES) + 1) * A**3
GRAMS = (A, A**2, A**3, SIZE)
HELD_OUT, STEP, THRESHOLDS = 5, 0.01, 2001
SIDES = ("allow", "block")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        what = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, what) if out is None else out.when(fits, what)
    return out


def symbols(url: Column) -> Column:
    """The URL's symbols as small numbers; empty for null."""
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")
    # Splitting an empty string gives one empty string, which is no symbol.
    return F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def class_of(symbol: Column) -> Column:
    """The class of a symbol."""
    of = {c: k + 1 for k, members in enumerate(CLASSES) for c in members}
    return F.get(F.array(*[F.lit(of.get(c, 0)) for c in f"\0{ALPHABET}\0"]), symbol)


def gram(third: Column, second: Column, last: Column, symbol: Column) -> Column:
    """The index of a symbol after the three before it."""
    return ((class_of(third) * A + second) * A + last) * A + symbol


def grams(s: Column) -> Column:
    """The gram of each symbol of the column s, START standing before the first."""
    before = lambda i, k: F.coalesce(F.get(s, i - k), F.lit(START))
    return F.transform(s, lambda c, i: gram(before(i, 3), before(i, 2), before(i, 1), c))


def model(judged: DataFrame) -> DataFrame:
    """One row: weights, the log-ratio of each gram, from rows (verdict, symbols).

    All tables here have at most SIZE rows, a bound fixed by the alphabet, so that they are broadcast.
    """
    spark = judged.sparkSession
    rows = judged.select("verdict", F.explode(grams(F.col("symbols"))).alias("g"))
    counts = cut(rows.groupBy("g").agg(*[F.count(F.when(F.col("verdict") == side, 1)).alias(side) for side in SIDES]))
    lower = None
    for size in GRAMS:
        seen = counts.groupBy(F.pmod("g", F.lit(size)).alias("g")).agg(*[F.sum(side).alias(side) for side in SIDES])
        context = seen.groupBy(F.floor(F.col("g") / A).alias("context")).agg(
            *[F.sum(side).alias(f"{side}_all") for side in SIDES], *[F.count(F.when(F.col(side) > 0, 1)).alias(f"{side}_kinds") for side in SIDES])
        grid = spark.range(size).withColumnRenamed("id", "g").withColumn("context", F.floor(F.col("g") / A))
        grid = grid.join(F.broadcast(seen), "g", "left").join(F.broadcast(context), "context", "left").fillna(0)
        if lower is None:
            grid = grid.withColumns({f"{side}_lower": F.lit(1.0 / (A - 1)) for side in SIDES})
        else:
            of, before = lower
            below = of.select(F.col("g").alias("below"), *[F.col(f"{side}_p").alias(f"{side}_lower") for side in SIDES])
            grid = grid.join(F.broadcast(below), F.pmod(F.col("g"), F.lit(before)) == F.col("below"))
        p = lambda side: F.when(F.col(f"{side}_all") > 0, (F.col(side) + F.col(f"{side}_kinds") * F.col(f"{side}_lower")) / (F.col(f"{side}_all") + F.col(f"{side}_kinds"))).otherwise(F.col(f"{side}_lower"))
        lower = grid.select("g", *[p(side).alias(f"{side}_p") for side in SIDES]), size
    both = counts.agg(*[F.coalesce(F.sum(side), F.lit(0)).alias(side) for side in SIDES]).first()
    ratio = F.log(F.col("allow_p") / F.col("block_p")) if both["allow"] and both["block"] else F.lit(0.0)
    listed = F.array_sort(F.collect_list(F.struct("g", ratio.alias("w"))))
    return cut(lower[0].agg(F.transform(listed, lambda x: x["w"]).alias("weights")))


def scored(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows, with `symbols` replaced by their score: one fold that carries the last three symbols, their number and the sum.

    `symbols` and `weights` are used once each, so that both stay parts of that expression and neither is copied into rows.
    """
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(START).alias("a"), F.lit(START).alias("b"), F.lit(START).alias("c"))

    def step(acc: Column, x: Column) -> Column:
        w = F.get("weights", gram(acc["a"], acc["b"], acc["c"], x))
        return F.struct((acc["sum"] + w).alias("sum"), (acc["n"] + 1).alias("n"), acc["b"].alias("a"), acc["c"].alias("b"), x.alias("c"))

    mean = F.aggregate("symbols", start, step, lambda acc: F.when(acc["n"] > 0, acc["sum"] / acc["n"]).otherwise(F.lit(0.0)))
    return rows.withColumn("weights", weights.scalar()).withColumn("score", mean).drop("weights", "symbols")


def threshold(held_out: DataFrame) -> float:
    """The threshold with the least sum of error rates on rows (verdict, score); runs on THRESHOLDS counts."""
    half = THRESHOLDS // 2
    bin_ = F.greatest(F.lit(-half), F.least(F.lit(half), F.floor(F.col("score") / STEP))).cast("long")
    n = {side: F.count(F.when(F.col("verdict") == side, 1)).alias(side) for side in SIDES}
    found = held_out.groupBy(bin_.alias("bin")).agg(*n.values())
    grid = held_out.sparkSession.range(-half, half + 1).withColumnRenamed("id", "bin").join(F.broadcast(found), "bin", "left").fillna(0)
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    allow, block = (F.sum(side).over(every) for side in SIDES)
    errors = (F.coalesce(F.sum("allow").over(below), F.lit(0)) * block + (block - F.coalesce(F.sum("block").over(below), F.lit(0))) * allow).alias("errors")
    edges = grid.select("bin", errors, (allow * block).alias("both")).where("both > 0")
    best = [r["bin"] for r in edges.withColumn("least", F.min("errors").over(Window.partitionBy("both"))).where("errors = least").select("bin").collect()]
    return min(best, key=lambda b: (abs(2 * b - min(best) - max(best)), b)) * STEP if best else 0.0


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold for each row of pages."""
    url = F.col("url").cast("string")
    host, path = parts(url)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("symbols", symbols(F.col("url")))
    judged = rows.where("fit is not null").select(F.col("fit.verdict").alias("verdict"), "symbols", (F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0).alias("held"))
    weights = model(judged.where("not held"))
    least = threshold(scored(judged.where("held"), weights))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= least, "allow").otherwise("block"))
    return scored(rows, weights).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score", F.lit(least).alias("threshold"))
