"""Row order over time, without putting all rows of a key into one task.

A window over raw log rows would send every row of a busy host to one task. Here rows are
first counted per *slot*: a key, a timestamp and a hash bucket. Sums and previous
timestamps run over slots in two levels, inside one hour and across hours, so that no
window holds more than the seconds of an hour or the hours of the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.sinks.tables import written_table

EARLIER = (Window.unboundedPreceding, -1)
#: Rows of a slot above which equal rows are counted before they are shuffled.
CROWDED_SLOT = 1 << 16
#: Copies of one row that a task puts out together.
COPIES_AT_ONCE = 1 << 12


def running_over_chunks(
    slots: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    amounts: Sequence[str] = (),
    last: str | None = None,
) -> DataFrame:
    """Adds sums over earlier slots (``<amount>_before``) and the ``previous`` slot's ``last``.

    ``chunk`` must grow with ``order``, and ``last`` must be an ordering column. Chunk
    totals are a small table: one row per key and chunk.
    """
    slots = slots.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    zero = F.lit(0).cast("bigint")

    totals = [F.sum(name).alias(f"_total_{name}") for name in amounts]
    carried = [
        F.sum(f"_total_{name}").over(across.rowsBetween(*EARLIER)).alias(f"_carried_{name}")
        for name in amounts
    ]
    inner = [
        F.sum(name).over(inside.rowsBetween(*EARLIER)).alias(f"_inner_{name}") for name in amounts
    ]
    added = [
        (F.coalesce(f"_inner_{name}", zero) + F.coalesce(f"_carried_{name}", zero)).alias(
            f"{name}_before"
        )
        for name in amounts
    ]
    if last is not None:
        totals.append(F.max(last).alias("_last"))
        carried.append(F.lag("_last").over(across).alias("_carried_last"))
        inner.append(F.lag(last).over(inside).alias("_inner_last"))
        added.append(F.coalesce("_inner_last", "_carried_last").alias("previous"))

    chunks = (
        slots.groupBy(*keys, "_chunk")
        .agg(*totals)
        .select(
            *[F.col(key).alias(f"_{key}") for key in keys],
            F.col("_chunk").alias("_carried_chunk"),
            *carried,
        )
    )
    # NULL is a key and a chunk like any other.
    same_chunk = F.col("_chunk").eqNullSafe(F.col("_carried_chunk"))
    for key in keys:
        same_chunk &= F.col(key).eqNullSafe(F.col(f"_{key}"))
    kept = [name for name in slots.columns if name != "_chunk"]
    return slots.select("*", *inner).join(chunks, same_chunk).select(*kept, *added)


def number_rows(
    rows: DataFrame,
    keys: Sequence[str],
    tie: Sequence[str],
    timestamp: str = "timestamp",
    spread: Column | None = None,
    crowded: int = CROWDED_SLOT,
) -> DataFrame:
    """Adds ``row_number`` and ``prev_timestamp`` per key, in time order.

    Rows without a timestamp come first. Equal timestamps are ordered by ``spread``, a small
    bucket number that splits even a single crowded second, and then by the ``tie`` columns.
    By default it is a hash of every column that can be hashed, so only rows that are equal
    throughout share a slot for certain. Rows of slots with more than ``crowded`` rows are
    counted by equal rows before they are shuffled, and put out again in parts of bounded
    size, so copies of one row meet in no task. Slot counts are stored when this is called.
    """
    if spread is None:
        spread = F.pmod(F.xxhash64(*hashable(rows)), F.lit(64))
    rows = rows.withColumn("_spread", spread)
    slot = [*keys, timestamp, "_spread"]
    counts = written_table(rows.groupBy(*slot).agg(F.count(F.lit(1)).alias("_rows")), "slots")
    slots = running_over_chunks(
        counts,
        keys,
        order=[timestamp, "_spread"],
        chunk=F.date_trunc("hour", timestamp),
        amounts=["_rows"],
        last=timestamp,
    )
    heads = slots.select(
        *slot, F.col("_rows_before").alias("_offset"), F.col("previous").alias("_slot_previous")
    )
    full = counts.where(F.col("_rows") > crowded)
    if full.isEmpty():
        ranked = rank_in_slots(rows, heads, slot, tie)
    else:
        marks = full.select(*[F.col(name).alias(f"_{name}_") for name in slot], F.lit(True).alias("_full"))
        marked = rows.join(marks, same_slot(slot), "left").select(*rows.columns, "_full")
        calm = marked.where("_full is null").drop("_full")
        copies = marked.where("_full").drop("_full")
        ranked = rank_in_slots(calm, heads, slot, tie).unionByName(
            rank_copies(copies, heads, slot, tie)
        )
    return ranked.select(
        *[name for name in rows.columns if name != "_spread"],
        F.when(F.col("_rank") == 1, F.col("_slot_previous"))
        .otherwise(F.col(timestamp))
        .alias("prev_timestamp"),
        (F.col("_offset") + F.col("_rank")).alias("row_number"),
    )


def hashable(rows: DataFrame) -> list[str]:
    return [f"`{f.name}`" for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]


def same_slot(slot: Sequence[str]) -> Column:
    """Whether the columns of a slot equal those named ``_<column>_``; NULL equals NULL."""
    return reduce(and_, [F.col(name).eqNullSafe(F.col(f"_{name}_")) for name in slot])


def rank_in_slots(
    rows: DataFrame, heads: DataFrame, slot: Sequence[str], tie: Sequence[str]
) -> DataFrame:
    """Adds ``_rank`` in the slot and the slot's ``_offset`` and ``_slot_previous``.

    Slots join their rows through a union, so the rows are shuffled once and NULL keys need
    no special case.
    """
    in_slot = Window.partitionBy(*slot).orderBy("_is_row", *tie)
    so_far = in_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.withColumn("_is_row", F.lit(1)).unionByName(
        heads.withColumn("_is_row", F.lit(0)), allowMissingColumns=True
    )
    numbered = both.select(
        *rows.columns,
        "_is_row",
        (F.row_number().over(in_slot) - 1).cast("bigint").alias("_rank"),
        F.first("_offset", ignorenulls=True).over(so_far).alias("_offset"),
        F.first("_slot_previous", ignorenulls=True).over(so_far).alias("_slot_previous"),
    )
    return numbered.where("_is_row = 1").drop("_is_row")


def rank_copies(
    rows: DataFrame, heads: DataFrame, slot: Sequence[str], tie: Sequence[str]
) -> DataFrame:
    """The same for crowded slots: equal rows travel as one row and a count.

    The window sees the distinct rows of a slot. Copies are dealt to tasks in parts before
    they become rows again.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    in_slot = Window.partitionBy(*slot).orderBy(*tie, F.xxhash64(*hashable(rows)))
    earlier = F.sum("_copies").over(in_slot.rowsBetween(*EARLIER))
    placed = counted.withColumn("_earlier", F.coalesce(earlier, F.lit(0).cast("bigint")))
    known = heads.withColumnsRenamed({name: f"_{name}_" for name in slot})
    parts = placed.join(known, same_slot(slot)).withColumn(
        "_first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, F.lit(COPIES_AT_ONCE)))
    )
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = F.least(F.col("_first") + COPIES_AT_ONCE, F.col("_copies")) - 1
    nth = F.explode(F.sequence(F.col("_first"), end))
    return (
        parts.repartition(tasks)
        .withColumn("_nth", nth)
        .select(
            *rows.columns,
            (F.col("_earlier") + F.col("_nth") + 1).alias("_rank"),
            "_offset",
            "_slot_previous",
        )
    )


def gap_seconds(timestamp: str, previous: str) -> Column:
    return F.unix_seconds(F.col(timestamp).cast("timestamp")) - F.unix_seconds(
        F.col(previous).cast("timestamp")
    )


def first_rows(rows: DataFrame, bucket: str, order: Sequence[str], count: Column) -> DataFrame:
    """Adds ``is_first``: whether a row is among the first ``count`` in (bucket, order).

    Exact without sorting all rows: bucket sizes are summed up to find the bucket that
    holds the limit, and only its rows are numbered to find the last row inside the limit.
    Every row is then compared with that one. ``count`` may use the column ``total``, the
    number of rows. ``bucket`` must not be NULL and ``order`` must be unique in a bucket.
    """
    sizes = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_size"))
    by_bucket = Window.orderBy(bucket)
    ends = sizes.select(
        F.col(bucket),
        F.coalesce(F.sum("_size").over(by_bucket.rowsBetween(*EARLIER)), F.lit(0)).alias("_start"),
        F.sum("_size").over(by_bucket).alias("_end"),
        F.sum("_size").over(Window.partitionBy()).alias("total"),
    ).withColumn("_limit", count.cast("bigint"))
    limit_inside = (F.col("_start") <= F.col("_limit")) & (F.col("_limit") < F.col("_end"))
    cut = ends.where(limit_inside).agg(
        F.struct(
            F.min(bucket).alias("bucket"),
            F.min(F.col("_limit") - F.col("_start")).alias("take"),
        )
    ).scalar()

    last = (
        rows.where(F.col(bucket) == cut.getField("bucket"))
        .select(
            F.struct(*order).alias("_order"),
            F.row_number().over(Window.partitionBy(bucket).orderBy(*order)).alias("_rank"),
            cut.getField("take").alias("_take"),
        )
        .where("_rank = _take")
        .agg(F.min("_order"))
    ).scalar()
    cut_bucket = cut.getField("bucket")
    at_or_before_last = (F.col(bucket) == cut_bucket) & (F.struct(*order) <= last)
    is_first = (
        F.when(cut_bucket.isNull() | (F.col(bucket) < cut_bucket), True)
        .otherwise(F.coalesce(at_or_before_last, F.lit(False)))
    )
    return rows.withColumn("is_first", is_first)


def burst_ids(
    gaps: DataFrame,
    keys: Sequence[str],
    threshold: Column,
    timestamp: str = "timestamp",
    gap: str = "time_diff_seconds",
) -> DataFrame:
    """Adds ``group_id``: how many gaps of the key reached the threshold up to this time.

    Rows of one timestamp share a group, since a running total over times counts them all.
    Rows with a NULL gap must be dropped before. ``threshold`` may be a column.
    """
    slot = [*keys, timestamp]
    seconds = gaps.groupBy(*slot).agg(F.count_if(F.col(gap) >= threshold).alias("_flags"))
    groups = running_over_chunks(
        seconds, keys, order=[timestamp], chunk=F.date_trunc("hour", timestamp), amounts=["_flags"]
    ).select(
        *[F.col(name).alias(f"_{name}") for name in slot],
        (F.col("_flags_before") + F.col("_flags")).alias("group_id"),
    )
    same_slot = F.col(timestamp).eqNullSafe(F.col(f"_{timestamp}"))
    for key in keys:
        same_slot &= F.col(key).eqNullSafe(F.col(f"_{key}"))
    return gaps.join(groups, same_slot).select(*gaps.columns, "group_id")


def previous_start(starts: DataFrame, keys: Sequence[str], start: str = "min_timestamp") -> DataFrame:
    """Adds ``prev_timestamp``: the start of the key's previous burst."""
    return running_over_chunks(
        starts, keys, order=[start], chunk=F.to_date(start), last=start
    ).withColumnRenamed("previous", "prev_timestamp")
