"""Mixing sources to target weights by systematic sampling.

Method
------
Each source has a target number of words; a document's expected copies are the target over
the words of its source, so all documents of a source expect the same number, at most
``LIMIT``. Documents of a source stand in a fixed order, short ones first and in hash order
among near equal sizes. The running sum of expected copies, plus one random offset for each
source, passes integers; a document is taken once for each integer that it passes. Every
stretch of the order, so every size, is taken at the source's rate, which keeps the taken
words near the target.

The running sum is the row's rank times the rate. Ranks are counted in two steps, so no task
orders a whole source: rows of (source, size class, two hash digits), then the offsets of
these groups, of which a source has at most 64 * 8 * 256 whatever its rows.

Targets
-------
Sources in code point order, null last, weigh 1, 2, 3, repeating, and share all words. No
target is above ``LIMIT`` times its source's words: water filling gives the excess to the
others by weight. It runs over the table of sources, one row each.

Cases
-----
Null text: no words. Documents without words follow the source's rate, so they are taken
too, with nothing to count. A source without words has target 0 and is not taken. Null
source: a source of its own. Null doc_id: a row of its own, placed by its text. Repeated rows: rows
of their own; equal rows stand next to each other in the order, in either order. Very long
texts: read whole; one can be most of its source, and then its copies are off by at most one.
Other columns are not read by ``copies``, whatever their names; ``mixed`` keeps them. Empty
tables: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.tables import stored, thinned

LIMIT = 3
WORD = "[^\\x20\\x09-\\x0D]+"


def sized(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` and the place in the source's order."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        size.alias("size"), F.xxhash64("text").alias("text_hash"),
        # Rows without doc_id are told apart by their text, so they do not stand in one place.
        F.when(F.col("doc_id").isNull(), F.md5("text")).alias("text_code"),
    )
    return rows.withColumns(
        {
            "size_class": F.floor(F.log2(F.col("size") + 1) * 8).cast("int"),
            "code": F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col("doc_id").cast("string"), F.col("text_code"), F.lit("")))),
        }
    ).drop("text_code").withColumn("part", F.substring("code", 1, 2))


def offset(source: Column) -> Column:
    """The random offset of a source: a multiple of 1/1024 from 0, so sums stay exact."""
    code = F.md5(F.concat(F.lit("offset-"), F.coalesce(source, F.lit(""))))
    return F.conv(F.substring(code, 1, 3), 16, 10).cast("int").bitwiseAND(1023) / F.lit(1024.0)


def targets(sizes: DataFrame) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size).

    The least level at which all words are given away: sources in the order of limit over
    weight reach their limit one after another.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    weighed = weighed.withColumn("most", F.col("source_size") * float(LIMIT))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    open_ = weighed.withColumn("level", level)
    # The first source whose share stays within its limit sets the level for all after it.
    within = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    final = open_.withColumn("level", F.first(within, ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ))
    return final.select(
        "source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target")
    )


def copies(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, text_hash, source_size, target, copies), one a document."""
    rows = stored(sized(documents), "sized")  # texts are read once; what follows is lean
    groups = rows.groupBy("source", "size_class", "part").agg(
        F.count("*").alias("n"), F.sum("size").alias("words")
    )
    goals = targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("size_class", "part")
    ahead = ahead.rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    starts = starts.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("no_source", F.col("source").isNull())
    goals = goals.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("no_source", F.col("source").isNull())
    starts = starts.drop("source").join(goals.drop("source"), ["s", "no_source"])
    starts = starts.select("s", "no_source", "size_class", "part", "ahead", "source_size", "target")
    within = Window.partitionBy("source", "size_class", "part").orderBy("code", "doc_id", "size", "text_hash")
    ranked = rows.withColumn("rank", F.row_number().over(within))
    ranked = ranked.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("no_source", F.col("source").isNull())
    placed = ranked.join(starts, ["s", "no_source", "size_class", "part"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place, shift = F.col("ahead") + F.col("rank"), offset(F.col("source"))
    taken = F.floor(place * rate + shift) - F.floor((place - 1) * rate + shift)
    return placed.select(
        "doc_id", "source", "size", "text_hash", "source_size", "target",
        F.least(taken, F.lit(LIMIT)).alias("copies"),
    )


def mixed(documents: DataFrame) -> DataFrame:
    """``documents`` with each row as often as the mix takes it.

    Rows that share doc_id, source and text share their copies, the first of them takes most.
    """
    keys = ["_doc", "_source", "_text"]

    def keyed(table: DataFrame, text_hash: Column) -> DataFrame:
        return table.withColumns(
            {
                "_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
                "_source": F.xxhash64(F.col("source").cast("string"), F.col("doc_id").cast("long")),
                "_text": text_hash,
            }
        )

    drawn = keyed(copies(documents), F.col("text_hash"))
    drawn = stored(
        drawn.groupBy(*keys).agg(F.count("*").alias("_rows"), F.sum("copies").alias("_copies")), "drawn"
    )
    packed = documents.select(
        "doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row")
    )
    packed = keyed(packed, F.xxhash64("_row.text")).select("_row", *keys)
    once = packed.join(drawn.filter("_rows = 1 and _copies > 0"), keys)
    several = drawn.filter("_rows > 1 and _copies > 0")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_doc")) - 1
    many = thinned(packed, several, "_text").join(several, keys).withColumn("_nth", nth)
    share = F.expr("(_copies + _rows - 1 - _nth) div _rows")
    many = many.withColumn("_copies", share).filter("_copies > 0").drop("_nth")
    out = once.unionByName(many)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select("_row.*")


#: DuckDB form of the query op10_mix.
SQL = """
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
  from documents),
o as (
  select *, row_number() over (partition by source
      order by floor(log2(size + 1) * 8)::int, md5('mix-' || coalesce(doc_id::varchar, '')), doc_id, size) as place
  from d),
s as (select source, sum(size)::double as n from d group by source),
w as (select source, n, ((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::double as weight,
        n * 3.0 as most from s),
l as (select *,
    (sum(n) over () - coalesce(sum(most) over (order by most / weight, source nulls last
        rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by most / weight, source nulls last
        rows between current row and unbounded following) as level,
    row_number() over (order by most / weight, source nulls last) as nr from w),
f as (select arg_min(level, nr) as level from l where level * weight <= most),
t as (select l.source, l.n, least(l.most, f.level * l.weight) as target,
        (('0x' || md5('offset-' || coalesce(l.source, ''))[1:3])::int & 1023) / 1024.0::double as shift
      from l, f)
select o.doc_id, o.size, t.n::bigint as source_size, t.target,
  (case when t.n > 0 then least(3, floor(place * (target / n) + shift) - floor((place - 1) * (target / n) + shift))
        else 0 end * o.size)::bigint as taken
from o join t on o.source is not distinct from t.source
"""
