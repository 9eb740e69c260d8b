"""Steps that several operators share: stored tables, bounded filters, components, ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import shared_folder, work_tables
from faultline.sinks.tables import written_table

#: Bits of a membership filter: 65,536 words of 64 bits, half a megabyte whatever the input.
FILTER_WORDS = 1 << 16


def stored(table: DataFrame, name: str) -> DataFrame:
    return written_table(table, f"llm-{name}")


def stored_alone(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``build`` returns, stored; tables that it stored for itself on the way are deleted."""
    path = shared_folder(spark, f"llm-{name}")
    with work_tables(spark):
        table = build()
        table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def shuffle_partitions(table: DataFrame) -> int:
    return int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hit_bits(table: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Joins a bitmap of fixed size of ``keys`` to ``table`` by broadcast, as _bit and _set."""
    slot = F.xxhash64(F.lit(17), F.col(key))
    word = F.shiftrightunsigned(slot, 6).bitwiseAND(FILTER_WORDS - 1)
    bit = F.call_function("shiftleft", F.expr("1L"), slot.bitwiseAND(63).cast("int"))
    bits = (
        keys.select(word.alias("_word"), bit.alias("_set"))
        .groupBy("_word")
        .agg(F.bit_or("_set").alias("_set"))
    )
    joined = table.withColumn("_word", word).withColumn("_bit", bit)
    return joined.join(F.broadcast(bits), "_word", how).drop("_word")


def thinned(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key may occur in ``keys``: all that do, and few others.

    Large rows that a later join would drop are not shuffled for it. A bitmap full of keys
    only lets more rows pass.
    """
    joined = hit_bits(table, keys, key, "inner")
    return joined.filter(F.col("_set").bitwiseAND(F.col("_bit")) != 0).drop("_bit", "_set")


def left_out(table: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """Rows of ``table`` whose key is not among the distinct ``keys``.

    A left join and a filter: Spark would move an anti join below the filter of ``thinned``,
    to all rows.
    """
    marked = keys.select(*names).withColumn("_there", F.lit(True))
    return table.join(marked, names, "left").filter(F.col("_there").isNull()).drop("_there")


def surely_without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows that ``thinned`` leaves out; they need no join with ``keys``."""
    joined = hit_bits(table, keys, key, "left")
    missed = F.col("_set").isNull() | (F.col("_set").bitwiseAND(F.col("_bit")) == 0)
    return joined.filter(missed).drop("_bit", "_set")


def components(links: DataFrame) -> DataFrame:
    """The least node of each linked group: rows (node, root) for nodes that have a link.

    ``links`` has columns a and b. Links are rewired to the least neighbour, first among
    larger and then among smaller nodes, until nothing changes; the number of rounds grows
    with the logarithm of the longest chain. Every round is stored in the shared folder.
    """

    def neighbours(edges: DataFrame) -> DataFrame:
        return edges.union(edges.select("b", "a"))

    def rewired(edges: DataFrame, larger: bool) -> DataFrame:
        both = neighbours(edges)
        near = both if larger else both.filter("b < a")
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        moved = both.filter("b > a") if larger else near
        out = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not larger:
            out = out.union(least.select("a", F.col("m").alias("b")))
        return out.filter("a != b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()

    def state(edges: DataFrame) -> tuple:
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(row)

    edges = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.distinct(), "links")
    before = state(edges)
    while before[0]:
        edges = stored(rewired(rewired(edges, True), False), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b").distinct())
