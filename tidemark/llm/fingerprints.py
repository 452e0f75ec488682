r"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (text between line feeds) hashes to a wide vector; a document's fingerprint is the sum
of its paragraphs' vectors modulo 2^32 per lane. So the order of paragraphs doesn't matter,
and inserting or deleting one adds or subtracts its vector. A vector has

- 8 lanes of the paragraph's own hash, for equality;
- 64 lanes that count, per bit, the paragraph's pieces (two words at a time) whose hash has the bit,
  and one lane with the number of pieces. The bits act as random signs, so the squared
  distance of two documents' lanes estimates the size of their multisets' difference.

likeness = 1 - difference / (pieces of both), clipped to 0..1; equal fingerprints: 1.

Null text counts as empty (one empty paragraph). Repeated rows each return a row; rows with one
doc_id are ordered by their text's hash, rows without an id come last, by their texts' hashes. In a table of one
row, the next document is the row itself. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Rows a bucket of neighbouring ids has on average, the most buckets there are, and keys that are looked at for each bucket's first.
BUCKET_ROWS, MOST_BUCKETS, EDGE_SAMPLE = 64, 1 << 14, 4
PIECE = r"[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)?"
PAIR = (1 << 32) | 1
LOW = (1 << 32) - 1


def order_key() -> Column:
    """Rises from the greatest doc_id to the least, rows without an id last; rows of one id, and those without, by their text's hash."""
    return F.struct(F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("down"), F.col("h").alias("h"))


def ranges(rows: DataFrame) -> list[tuple]:
    """The first keys of ranges of rows (doc_id, h) that hold about as many rows each: keys of rows themselves, in order.

    They are chosen among a hash-drawn sample of distinct keys, EDGE_SAMPLE times as many as ranges, so the driver
    holds MOST_BUCKETS * EDGE_SAMPLE keys at most, about. Any choice gives the same fingerprints.
    """
    n = rows.count()
    if not n:
        return []
    most = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    share = min(1 << 40, (most * EDGE_SAMPLE << 40) // n + 1)
    keys = rows.select(order_key().alias("key")).where(F.pmod(F.xxhash64(F.lit("edge"), "key"), F.lit(1 << 40)) < share)
    found = sorted(tuple(r.key) for r in keys.distinct().collect()) or [tuple(rows.select(F.min(order_key())).first()[0])]
    return [found[i * len(found) // most] for i in range(most)] if len(found) > most else found


def with_next(documents: DataFrame) -> DataFrame:
    """bucket, rn (place in it), buckets, doc_id, text and next: the text of the next document by descending doc_id.

    A bucket is a range of ids with about as many rows as any other, wherever ids lie dense. Rows before the first
    range's key end the last range, as the order is a circle; so every range's next row is the first of the one after.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    edges = ranges(d.select("doc_id", "h"))
    spark, count = d.sparkSession, max(1, len(edges))
    # Literals: the optimizer folds each once, and rows don't carry them.
    none, down, h = (F.expr("cast(split('" + ",".join(str(k[i]) for k in edges) + "', ',') as array<bigint>)") for i in range(3))
    first = lambda i: F.struct(F.get(none, i).cast("int").alias("none"), F.get(down, i).alias("down"), F.get(h, i).alias("h"))
    steps = F.array(*[F.lit(1 << k) for k in range((count - 1).bit_length() - 1, -1, -1)]) if count > 1 else F.array().cast("array<int>")
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < count) & (first(at + step) <= F.col("key")), at + step).otherwise(at))
    wrapped = (F.col("key") < first(F.lit(0))) if edges else F.lit(False)
    b = d.withColumn("key", order_key()).select(F.when(wrapped, F.lit(count - 1)).otherwise(found).alias("bucket"), wrapped.alias("wrapped"), "key", "doc_id", "text")
    heads = spark.createDataFrame([(*k, (i - 1) % count) for i, k in enumerate(edges)], "none int, down long, h long, bucket int")
    head = d.withColumn("key", order_key()).join(F.broadcast(heads), F.col("key") == F.struct("none", "down", heads["h"]))  # keys: bounded
    head = head.groupBy("bucket").agg(F.min("text").alias("after"))
    w = Window.partitionBy("bucket").orderBy("wrapped", "key")
    rows = b.select("bucket", F.row_number().over(w).alias("rn"), "doc_id", "text", F.lead("text").over(w).alias("within"))
    rows = rows.join(head, "bucket", "left")
    return rows.select("bucket", "rn", F.lit(count).alias("buckets"), "doc_id", "text", F.coalesce("within", "after").alias("next"))


def fingerprint_rows(texts: DataFrame, key: list[str]) -> DataFrame:
    """Key columns plus exact (8 lanes), lanes (64 lanes, two to a long) and pieces, for texts with a column text."""
    p = texts.select(*key, F.explode(F.split("text", "\n")).alias("p"))
    p = p.select(*key, "p", *[F.xxhash64(F.lit(i), F.col("p")).alias(f"e{i}") for i in range(4)])
    p = p.select(*key, *[f"e{i}" for i in range(4)], F.posexplode_outer(F.regexp_extract_all("p", F.lit(PIECE), 0)).alias("at", "piece"))
    p = p.withColumn("x", F.xxhash64("piece")).withColumn("once", F.coalesce(F.col("at"), F.lit(0)) == 0)
    own = [F.when(F.col("once"), part).otherwise(F.lit(0).cast("long")) for i in range(4) for part in (F.col(f"e{i}").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(f"e{i}", 32))]
    bits = [F.when(F.col("at").isNotNull(), F.shiftrightunsigned("x", j).bitwiseAND(F.lit(PAIR))) for j in range(32)]
    g = p.groupBy(*key).agg(F.count("at").alias("pieces"), *[F.sum(c).alias(f"o{i}") for i, c in enumerate(own)], *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(f"b{j}") for j, c in enumerate(bits)])
    return g.select(*key, "pieces", F.array(*[F.col(f"o{i}").bitwiseAND(F.lit(LOW)) for i in range(8)]).alias("exact"), F.array(*[f"b{j}" for j in range(32)]).alias("lanes"))


def likeness(a: str, b: str) -> Column:
    """Likeness of two structs (pieces, exact, lanes)."""
    lane = lambda part: f"cast(power(2 * (({part.format('x')}) - ({part.format('y')})) - ({a}.pieces - {b}.pieces), 2) as double)"
    square = f"aggregate(zip_with({a}.lanes, {b}.lanes, (x, y) -> {lane('({0} & ' + str(LOW) + 'L)')} + {lane('shiftrightunsigned({0}, 32)')}), 0D, (s, d) -> s + d)"
    return F.expr(f"""CASE WHEN {a} = {b} THEN 1D WHEN {a}.pieces + {b}.pieces = 0 THEN 0D
        ELSE greatest(0D, least(1D, 1 - {square} / 64 / ({a}.pieces + {b}.pieces))) END""")


def text_of(f: str) -> Column:
    """The fingerprint as hexadecimal digits."""
    return F.expr(f"lower(concat(lpad(hex({f}.pieces), 8, '0'), array_join(transform({f}.exact, x -> lpad(hex(x), 8, '0')), ''), array_join(transform({f}.lanes, x -> lpad(hex(x), 16, '0')), '')))")


def fingerprints(documents: DataFrame) -> DataFrame:
    d = with_next(documents)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next", F.lit(1), third))
    d = d.select("bucket", "rn", "buckets", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    d = d.withColumn("sha", F.unhex(F.sha2("edited", 256)))
    key = ["bucket", "rn", "buckets", "e", "doc_id", "n_chars", "sha"]
    d = d.select("bucket", "rn", "buckets", "doc_id", "n_chars", "sha", F.posexplode(F.array("text", "edited")).alias("e", "text"))
    # The rows of a bucket are together already, so nothing is shuffled again.
    f = saved(fingerprint_rows(d, key).withColumn("f", F.struct("pieces", "exact", "lanes")).drop("pieces", "exact", "lanes"))
    w = Window.partitionBy("bucket").orderBy("rn", "e")
    rows = f.select("bucket", "doc_id", "n_chars", "sha", "e", "f", F.lead("f").over(w).alias("edited"), F.lead("f", 2).over(w).alias("within")).where("e = 0")
    first = f.where("rn = 1 AND e = 0").select(F.expr("pmod(bucket - 1, buckets)").alias("bucket"), F.col("f").alias("after"))
    rows = rows.join(first, "bucket", "left").withColumn("next", F.coalesce("within", "after"))
    return rows.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), text_of("f").alias("fingerprint"), text_of("edited").alias("edited_fingerprint"),
        likeness("f", "edited").alias("near_edited"), likeness("f", "next").alias("near_next"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
