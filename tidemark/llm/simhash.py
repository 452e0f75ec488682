"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within RADIUS = 2 bits share a point at most 1 bit from each. So every distinct
fingerprint emits itself and its 64 one-bit variants, variants are shuffled, and neighbours in a
variant's sorted ball are linked after their distance is verified. A ball holds 65 fingerprints at
most, however many documents there are; equal fingerprints are collapsed before.

Nulls and texts without words have fingerprint zero, linked like any other. Repeated rows each
return a row. A component's id is its least doc_id that isn't null (null if there is none). An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table, words
from .components import components, salted

RADIUS = 2
SHINGLE = 3
#: Selects bits j and j + 32 of a shifted hash, so that one sum counts two bits.
PAIR = (1 << 32) | 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(documents: DataFrame, *also: str) -> DataFrame:
    """doc_id, fp (long) and the columns `also`: a row per row. Bits are counted per task before the shuffle."""
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    d = documents.select("doc_id", *also, F.monotonically_increasing_id().alias("rid"), words(low).alias("w"))
    h = F.expr(f"""CASE WHEN size(w) = 0 THEN cast(array() as array<bigint>)
        WHEN size(w) < {SHINGLE} THEN array(xxhash64(array_join(w, ' ')))
        ELSE transform(sequence(0, size(w) - {SHINGLE}), i -> xxhash64(concat(get(w, i), ' ', get(w, i + 1), ' ', get(w, i + 2)))) END""")
    h = d.select("doc_id", *also, "rid", F.explode_outer(h).alias("h"))
    two = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(PAIR))).alias(f"s{j}") for j in range(32)]
    c = h.groupBy("rid", "doc_id", *also).agg(F.count("h").alias("n"), *two)
    fp: Column = F.lit(0).cast("long")
    for j in range(32):
        for of, bit in ((F.col(f"s{j}").bitwiseAND(F.lit((1 << 32) - 1)), j), (F.shiftrightunsigned(f"s{j}", 32), j + 32)):
            fp = fp.bitwiseOR(F.when(2 * of > F.col("n"), F.lit(_signed(1 << bit))).otherwise(F.lit(0).cast("long")))
    return c.select("doc_id", fp.alias("fp"), *also)


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all those within RADIUS bits."""
    ball = F.explode(F.array("fp", *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << j))) for j in range(64)]))
    v = fps.select("fp").distinct().select("fp", ball.alias("v"))
    w = Window.partitionBy("v").orderBy("fp")
    near = v.select(F.col("fp").alias("a"), F.lag("fp").over(w).alias("b")).where("b IS NOT NULL")
    return near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def roots(fps: DataFrame) -> DataFrame:
    """fp, least (the least doc_id that has it) and root (its class) of each fingerprint."""
    found = components(links(fps))
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    return saved(own.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def classes(fps: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for a saved table of fingerprints. Rows of one fingerprint, and fingerprints of one class, are joined in parts."""
    own = roots(fps)
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return salted(fps, salted(own, least, "root", "fp").select("fp", "component_id"), "fp", "doc_id").select("doc_id", "fp", "component_id")


def simhash_classes(documents: DataFrame) -> DataFrame:
    c = classes(saved(fingerprints(documents)))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each class of rows: of those with the least doc_id (rows without one come last) the one with the least digest of all its columns.

    Rows are told apart by id and digest, so rows of different classes stay though they share an id.
    """
    columns = documents.columns
    digest = F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])), 256)
    keyed = documents.withColumn("_row", digest)
    fps = saved(fingerprints(keyed, "_row"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = salted(fps, roots(fps).select("fp", "root"), "fp", "_row").groupBy("root").agg(F.min(order).alias("x")).select("x.*").select(F.col("doc_id").alias("_id"), F.col("_row").alias("_same"))
    own = keyed.join(first, keyed["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_same")), "left_semi")
    return own.groupBy("_row").agg(F.first(F.struct(*columns)).alias("row")).select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))
