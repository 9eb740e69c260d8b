"""Spelling variant grouping: rare words that are one edit from a far more frequent word.

Method
------
1. Runs of letters of all texts are counted as words; short and single ones leave.
2. Letters are hashed to a few symbols, which turns a word into a *reduced* word. If two words
   differ by one edit, their reduced words differ by one edit or by none.
3. The one-edit neighbourhood of every reduced word is generated and joined with the reduced
   vocabulary. A pair is generated from one of its sides: a letter is left out (the other side
   would insert it) or its symbol is raised (the other side would lower it), so both sides
   together give the full neighbourhood, at half the rows.
   An edit leaves the first or the last half of a word as it was, and where the edit is tells
   which one. The join key has that half as it is written, so words that share a reduced word
   do not all meet: no pair of near words is lost, and hot reduced words are split.
4. Candidates are verified on the original words by their edit distance.
5. A word's form is its most frequent near word, if that is frequent enough; forms are followed
   to the last by joining them with themselves, which doubles the steps each time. Every step
   multiplies the count by ``ratio``, so chains are short.

All steps are DataFrame operations; tables between them lie in the shared folder.

Cases
-----
Null, empty and blank texts and texts without letters: no words. Very long texts: read whole.
Repeated rows count as often as they occur. Null doc_id: counts as the empty id where the query
hashes doc_ids. Ties of frequency: the word that is first in code-point order. Empty table: no
rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import shuffle_partitions, stored

#: Letters besides a to z: the code points from À to ÿ.
LETTERS = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[a-zÀ-ÿ]"
SYMBOLS = 4


def runs_of_letters(documents: DataFrame, least: int) -> DataFrame:
    """Rows (doc_id, run) for maximal runs of at least ``least`` letters, A-Z lower-cased."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    found = F.regexp_extract_all(text, F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    return documents.select("doc_id", F.explode(found).alias("run"))


def vocabulary(words: DataFrame, least_letters: int, least_count: int) -> DataFrame:
    """Rows (word, n), stored: words that are long and frequent enough."""
    counted = words.filter(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return stored(counted.filter(F.col("n") >= least_count), "vocabulary")


def reduced(word: Column, symbols: int) -> Column:
    """Each letter as one of the symbols a, b, ... by its hash; others stay as they are."""
    marks = "".join(chr(ord("a") + zlib.crc32(letter.encode()) % symbols) for letter in LETTERS)
    return F.translate(word, "".join(LETTERS), marks)


def first_half(word: Column, size: Column) -> Column:
    return F.substring(word, F.lit(1), F.floor(size / 2).cast("int"))


def last_half(word: Column, size: Column) -> Column:
    half = F.floor(size / 2).cast("int")
    return F.substring(word, F.char_length(word) - half + 1, half)


def join_key(shape: Column, side: int, half: Column) -> Column:
    return F.xxhash64(shape, F.lit(side), half)


def neighbour_keys(word: str, shape: str, symbols: int) -> Column:
    """Keys of the reduced neighbours with a letter left out or a symbol raised.

    ``i`` is the place of the edit, from 1. The half that the edit leaves alone belongs to both
    words; its length follows from the shorter one.
    """
    text, short = F.col(word), F.col(shape)
    size = F.char_length(text)

    def key(new: Column, i: Column, length: Column) -> Column:
        before = i > F.floor(length / 2)  # the edit comes after the first half
        return F.when(before, join_key(new, 0, first_half(text, length))).otherwise(
            join_key(new, 1, last_half(text, length))
        )

    def around(i: Column, middle: Column) -> Column:
        return F.concat(F.substring(short, F.lit(1), i - 1), middle, F.substring(short, i + 1, size))

    places = F.sequence(F.lit(1), size)
    left_out = F.transform(places, lambda i: key(around(i, F.lit("")), i, size - 1))

    def raised(mark: str) -> Column:
        lower = F.filter(places, lambda i: F.substring(short, i, F.lit(1)) < mark)
        return F.transform(lower, lambda i: key(around(i, F.lit(mark)), i, size))

    marks = [chr(ord("a") + k) for k in range(1, symbols)]
    return F.array_distinct(F.concat(left_out, *[raised(mark) for mark in marks]))


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Rows (word, n, other, other_n), both ways, for words that are exactly one edit apart."""
    # Each word becomes some thirty rows, so its table is dealt to more tasks than it has files.
    shapes = words.repartition(shuffle_partitions(words)).withColumn("shape", reduced(F.col("word"), symbols))
    size = F.char_length("word")
    own = F.array(
        join_key(F.col("shape"), 0, first_half(F.col("word"), size)),
        join_key(F.col("shape"), 1, last_half(F.col("word"), size)),
    )
    known = shapes.select(F.explode(own).alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    around = shapes.select(F.explode(neighbour_keys("word", "shape", symbols)).alias("key"), "word", "n")
    same = known.select("key", F.col("other").alias("word"), F.col("other_n").alias("n"))
    one_edit = F.levenshtein("word", "other", 1) == 1
    found = around.join(known, "key").filter(one_edit).unionByName(
        same.join(known, "key").filter(F.col("word") < F.col("other")).filter(one_edit)
    )
    least = F.col("word") < F.col("other")
    pairs = found.select(
        F.when(least, F.col("word")).otherwise(F.col("other")).alias("word"),
        F.when(least, F.col("n")).otherwise(F.col("other_n")).alias("n"),
        F.when(least, F.col("other")).otherwise(F.col("word")).alias("other"),
        F.when(least, F.col("other_n")).otherwise(F.col("n")).alias("other_n"),
    ).distinct()
    both = F.array(
        F.struct("word", "n", "other", "other_n"),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"),
                 F.col("n").alias("other_n")),
    )
    return pairs.select(F.inline(both))


def followed(forms: DataFrame) -> DataFrame:
    """Rows (word, root) for rows (word, form): the end of each word's chain of forms."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(further, "root", "left_semi").isEmpty():
            return roots
        roots = roots.join(further, "root", "left")
        roots = stored(roots.select("word", F.coalesce("next", "root").alias("root")), "roots")


def variant_groups(
    words: DataFrame, least_letters: int = 7, least_count: int = 2, ratio: int = 10, symbols: int = SYMBOLS
) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for rows (word), one for each occurrence."""
    counted = vocabulary(words, least_letters, least_count)
    best = F.min(F.struct((-F.col("other_n")).alias("order"), "other"))
    near = stored(
        near_pairs(counted, symbols).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best")),
        "near",
    )
    enough = -F.col("best.order") >= ratio * F.col("n")
    near = near.select(
        "word", "n_near", F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.order")).alias("form_n"),
    )
    roots = followed(near.filter("form is not null"))
    return (
        counted.join(near, "word", "left").join(roots, "word", "left")
        .select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
        )
    )


def with_slips(documents: DataFrame, least: int, every: int = 31) -> DataFrame:
    """The words that the query counts: of one run in ``every`` a letter is left out."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    rows = runs_of_letters(documents, least).withColumn("h", F.crc32(name.cast("binary")))
    place = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(
        F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.char_length("run"))
    )
    return rows.select(F.when(F.pmod("h", F.lit(every)) == 0, cut).otherwise(F.col("run")).alias("word"))


#: DuckDB form of the query op11_spelling_variants: near words are equal when one letter is left
#: out of the longer one, or the letter at the same place of both.
SQL = """
with recursive step as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) as crc),
runs as (
  select doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-zÀ-ÿ]+')) as run from documents),
named as (
  select doc_id, run, count(*) as times, coalesce(doc_id::varchar, '') || ':' || run as name
  from runs where length(run) >= 7 group by doc_id, run),
bytes as (
  select doc_id, run, times, flatten(list_transform(string_split(name, ''), lambda c:
    case when unicode(c) < 128 then [unicode(c)::bigint]
      else [(192 | (unicode(c) >> 6))::bigint, (128 | (unicode(c) & 63))::bigint] end)) as b from named),
hashed as (
  select run, times, xor(4294967295, list_reduce(list_concat([4294967295], b),
    lambda x, y: xor(x >> 8, step.crc[(xor(x, y) & 255) + 1]))) as h from bytes, step),
words as (
  select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int)
      || substr(run, (h % length(run))::int + 2) else run end as word, times from hashed),
voc as (
  select word, sum(times)::bigint as n from words where length(word) >= 7
  group by word having sum(times) >= 2),
cut as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as c
  from (select word, n, unnest(range(1, length(word) + 1)) as i from voc)),
near as (
  select a.word, a.n, b.word as other, b.n as other_n
  from cut a join cut b on a.c = b.c and a.i = b.i and a.word <> b.word
  union select a.word, a.n, b.word, b.n from cut a join voc b on a.c = b.word
  union select b.word, b.n, a.word, a.n from cut a join voc b on a.c = b.word),
best as (
  select word, count(*) as n_near, arg_min({'w': other, 'n': other_n}, {'n': -other_n, 'w': other}) as best
  from near group by word),
rows as (
  select voc.word, n, coalesce(n_near, 0) as n_near,
    case when best.n >= 10 * n then best.w end as form, case when best.n >= 10 * n then best.n end as form_n
  from voc left join best using (word)),
chain(word, root) as (
  select word, word from rows
  union all select chain.word, rows.form from chain join rows on rows.word = chain.root where rows.form is not null),
ends as (select chain.word, chain.root from chain join rows on rows.word = chain.root where rows.form is null)
select rows.word, rows.form, ends.root, rows.n, rows.n_near, rows.form_n from rows join ends using (word)
"""
