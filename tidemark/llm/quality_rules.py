"""Quality rules whose cut-offs follow each language and source.

Per document a handful of rates is measured with built-in functions. Each rate goes into a
log-bucket quantile sketch (relative error GAMMA - 1) per language and source: a sketch is a set of
(bucket, count) rows, so sketches merge by adding counts, and a language's sketch is the
sum of its sources' sketches. A document is over the cut-off of a rate if

    sqrt(rate) > sqrt(q75) + SPREAD * max(sqrt(q75) - sqrt(q25), what chance does to a text of that length)

On the scale of roots the scatter of a count doesn't depend on the rate: chance alone puts NOISE * sqrt(UNIT / n) between the
quartiles of texts of n words or characters, UNIT being how many of them one event counts. So a group whose texts
all have none of something doesn't reject a text for its first one, and no rate has a fixed cut-off or allowance.

The quartiles are shrunk by weight: a language's own count for its texts and everything's for PRIOR more,
a source's own for its texts and its language's for PRIOR more. A document over any cut-off isn't kept.

Nulls: text counts as empty; null lang or source is a group of its own. Empty texts fail the base
rule (under 20 words). Repeated rows each count and each return a row. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, saved, table, words

GAMMA = 1.05
PRIOR = 50
SPREAD = 3.0
#: Rates: the count, what it is counted in, and how many of these one event counts (a window of 8 words found twice: 16).
RATES = {
    "symbol_rate": ("n_symbols", "word_chars", 1), "upper_rate": ("n_upper", "word_chars", 1), "repeat_rate": ("n_repeat_words", "n_words", 16),
    "stutter_rate": ("n_stutter", "n_words", 1), "mark_rate": ("n_marks", "word_chars", 1),
}
#: The distance of the quartiles of a normal distribution, times the deviation of a count's root, a half.
NOISE = 1.35 / 2
#: Rates below this share the lowest bucket.
FLOOR = 1e-4
#: A table of cut-offs up to this many groups is broadcast; a larger one is joined by key.
BROADCAST_GROUPS = 50_000


def _at(array: str, i: str) -> str:
    return f"get({array}, {i})"


def measures(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the rates of each document; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = documents.select("doc_id", "lang", "source", text.alias("text"), words(text).alias("w"))
    # Hashes of words stand for them: equal windows are those with equal window hashes.
    d = d.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^!?|#*$%&<>]+", "")).cast("long").alias("n_marks"),
        F.expr(rf"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    d = d.withColumn("win", F.expr("""CASE WHEN n_words < 8 THEN cast(array() as array<bigint>) ELSE
        transform(sequence(0, cast(n_words as int) - 8), i -> xxhash64(get(h, i), get(h, i + 1), get(h, i + 2), get(h, i + 3), get(h, i + 4), get(h, i + 5), get(h, i + 6), get(h, i + 7))) END"""))
    # Only texts with an equal pair of windows pay for sorting them.
    d = d.withColumn("s", F.expr("CASE WHEN size(array_distinct(win)) = size(win) THEN NULL ELSE array_sort(transform(win, (x, i) -> struct(x as x, i as i))) END"))
    d = d.withColumn("p", F.expr("""array_sort(transform(filter(transform(s, (e, k) -> struct(e.i as i, (e.x <=> get(s, k - 1).x OR e.x <=> get(s, k + 1).x) as twice)), e -> e.twice), e -> e.i))"""))
    return d.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN s IS NULL THEN 0L ELSE aggregate(transform(p, (x, k) -> least(8, coalesce(get(p, k + 1) - x, 8))), 0L, (a, x) -> a + x) END").alias("n_repeat_words"),
        "n_upper", "n_marks",
        F.expr("size(filter(transform(h, (x, i) -> x <=> get(h, i - 1)), x -> x))").cast("long").alias("n_stutter"),
    )


def rates(measured: DataFrame) -> DataFrame:
    per = lambda n, of: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(of).cast("double")), F.lit(0.0))
    return measured.withColumns({name: per(n, of) for name, (n, of, _) in RATES.items()})


def sketch(rated: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n: mergeable by adding n. Partial counts are made before the shuffle."""
    bucket = F.greatest(F.lit(0), F.ceil(F.log(F.col("v") / FLOOR) / F.log(F.lit(GAMMA))) + 1)
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("rate"), F.col(n).alias("v")) for n in RATES]))
    return (
        rated.where("n_words >= 20").select("lang", "source", parts.alias("p")).select("lang", "source", "p.rate", "p.v")
        .select("lang", "source", "rate", F.when(F.col("v") <= FLOOR, 0).otherwise(bucket).cast("int").alias("bucket"))
        .groupBy("lang", "source", "rate", "bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def _quartiles(buckets: DataFrame, by: list[str]) -> DataFrame:
    """docs, lo and hi (roots of the quartiles) of each group and rate; a group has a few hundred buckets at most, whatever its size."""
    w = Window.partitionBy(*by, "rate")
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(F.sqrt(FLOOR * F.pow(F.lit(GAMMA), F.col("bucket") - 1)))
    b = buckets.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))
    b = b.select("*", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("docs"), value.alias("v"))
    q = lambda p: F.min(F.when(F.col("upto") >= F.col("docs") * p, F.col("v")))
    return b.groupBy(*by, "rate").agg(F.max("docs").alias("docs"), q(0.25).alias("lo"), q(0.75).alias("hi"))


def thresholds(buckets: DataFrame) -> DataFrame:
    """lang, source and, for each rate, a struct (lo, hi) of its shrunk quartiles' roots."""
    own = _quartiles(buckets, ["lang", "source"]).withColumnsRenamed({"docs": "d0", "lo": "lo0", "hi": "hi0"})
    lang = _quartiles(buckets, ["lang"]).select(F.col("lang").alias("l1"), F.col("rate").alias("r1"), F.col("docs").alias("d1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    whole = _quartiles(buckets, []).select(F.col("rate").alias("r2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    t = own.join(lang, F.col("lang").eqNullSafe(F.col("l1")) & (F.col("rate") == F.col("r1"))).join(whole, F.col("rate") == F.col("r2"))
    shrunk = lambda d, x, above: (F.col(d) * F.col(x) + PRIOR * above) / (F.col(d) + PRIOR)
    of = lambda q: shrunk("d0", f"{q}0", shrunk("d1", f"{q}1", F.col(f"{q}2"))).alias(q)
    return t.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == n, F.struct(of("lo"), of("hi")))).alias(f"at_{n}") for n in RATES])


def quality_rules(documents: DataFrame) -> DataFrame:
    """The base counts, base_failed, kept, and the rates with their cut-offs, a row per row of documents."""
    rated = saved(rates(measures(documents)))
    cut = saved(thresholds(sketch(rated))).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    by = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_GROUPS else cut
    rows = rated.join(cut, by, "left")
    for n, (_, of, unit) in RATES.items():
        at, noise = F.col(f"at_{n}"), NOISE * F.sqrt(F.try_divide(F.lit(float(unit)), F.col(of).cast("double")))
        rows = rows.withColumn(f"max_{n}", F.pow(at["hi"] + SPREAD * F.greatest(at["hi"] - at["lo"], noise), F.lit(2.0)))
    over = F.lit(False)
    for n in RATES:
        over = over | F.coalesce(F.col(n) > F.col(f"max_{n}"), F.lit(False))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~over).alias("kept"), "lang", "source", *RATES, *[f"max_{n}" for n in RATES],
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
