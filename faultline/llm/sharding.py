"""Proportional stratified interleaving: shards whose mixture is that of the whole.

Method
------
Rows of each source are shuffled by a seeded hash and ranked; rank r of n becomes the
fraction (r - 1/2) / n. All rows sorted by that fraction carry every source at its share
in every stretch. The order is cut into shards whose row counts differ by at most one, the
law called ``rows``.

No task orders a source or the whole table. Ranks are counted in two steps: rows of (source,
hash digits), then the offsets of these groups, 4,096 for each source. Places in the
whole order likewise: fractions fill [0, 1) evenly by construction, so ranges of equal width
hold equal numbers of rows.

Cases
-----
Null text: no bytes, checksum of the empty text. Null source: a source of its own. Rows that
share doc_id and text are interchangeable. Null doc_id: spread by the text's checksum. Empty
tables: no rows. Very long texts: only their size and checksums are carried. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SEED = 16, 20240229
#: Ranges of the whole order; a table of that many counts is summed up in one task.
RANGES = 1 << 14


def interleaved(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, source, size, text_crc32, shard, slot), one for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = rows.withColumn("code", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    rows = rows.withColumn("digits", F.shiftrightunsigned("code", 52))

    groups = rows.groupBy("stratum", "digits").agg(F.count("*").alias("n"))
    of = Window.partitionBy("stratum")
    ahead = of.orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        "stratum", "digits",
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"),
        F.sum("n").over(of).alias("total"),
    )
    inside = Window.partitionBy("stratum", "digits").orderBy("code", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(inside)).join(groups, ["stratum", "digits"])
    # Integer arithmetic: the range of (2 rank - 1) / (2 total), and the remainder in it.
    twice = (2 * (F.col("ahead") + F.col("rank")) - 1).cast("decimal(20,0)") * RANGES
    ranked = ranked.select(
        "doc_id", "size", "text_crc32", "stratum", "code",
        F.floor(twice / (2 * F.col("total"))).cast("int").alias("range"),
        ((2 * (F.col("ahead") + F.col("rank")) - 1) / (2.0 * F.col("total"))).alias("fraction"),
    )
    counts = ranked.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "range",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("rows"),
    )
    order = Window.partitionBy("range").orderBy("fraction", "stratum", "code", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("nth", F.row_number().over(order)).join(counts, "range")
    place = F.col("before") + F.col("nth") - 1
    # Shard k starts at ceil(k rows / shards), so shard and start follow from the place.
    shard = F.expr(f"(before + nth - 1) * {shards} div rows")
    placed = placed.withColumn("shard", shard.cast("int")).withColumn("place", place)
    start = F.expr(f"(cast(shard as bigint) * rows + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id",
        F.when(F.col("stratum") == "", None).otherwise(F.expr("substring(stratum, 2)")).alias("source"),
        "size", "text_crc32", "shard", (F.col("place") - start).alias("slot"),
    )
