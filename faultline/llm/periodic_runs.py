"""Periodic runs: stretches of words that repeat with a period, found from Lyndon roots.

Method
------
A *run* is a stretch of consecutive words with smallest period q, of at least ``LEAST`` words
and ``TIMES`` periods, that no neighbouring word extends. Each run has a Lyndon root: for some
order of the words or its inverse, the longest Lyndon word that starts at a position of the run
is one period long.

1. Words of a text are numbered by equality. With ``LEAST // TIMES`` words to a window, every
   window inside a run occurs in it again, so only stretches whose windows all occur twice in
   the text are looked at. Windows are compared by hash; equal windows have equal hashes, so a
   collision can only add a stretch.
2. The first phase of Baier's suffix sorter groups the positions of a stretch by their longest
   Lyndon prefix. Groups are taken from the largest; every member hands its prefix to the
   nearest position to its left that is still in a smaller group, and positions that receive
   the same number of them move on together, to a group next to their old one. The length of a
   group's prefix is the Lyndon array; no suffix has to be ordered inside a group. This is done
   for the order and for its inverse.
3. A position whose Lyndon word comes again as often as a run needs is a root. How far the text
   agrees with itself one period on, to the right and to the left (the longest common extension
   of the root's two places), gives the run. Words are compared by number, that is exactly, in
   steps that double.

One text is held by one task, as words and a few numbers a word; time grows with its length.

Cases
-----
Null, empty and blank texts: no runs, an empty collapsed text. Very long texts: read whole; a
task holds one text's words. Ties, repeated rows and null doc_ids: every row by itself. Empty
table: no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.words import byte_rows, mix, window_hashes

#: Words of a run at least, and periods.
LEAST, TIMES = 24, 3

Run = tuple[int, int, int]  # start, length, period
Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def lyndon_array(letters: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each position; letters are 0, 1, ... by order.

    Groups are a linked list by order. A position that has been handed on is skipped by
    everyone to its right, which ``left`` remembers with shortened paths.
    """
    count = max(letters) + 1
    members: list[list[int]] = [[] for _ in range(count)]
    for place, letter in enumerate(letters):
        members[letter].append(place)
    live = [len(m) for m in members]
    width = [1] * count
    below, above = list(range(-1, count - 1)), list(range(1, count + 1))
    group = list(letters)
    left = list(range(-1, len(letters) - 1))
    done = bytearray(len(letters))

    def open_left(place: int) -> int:
        near = left[place]
        while near >= 0 and done[near]:
            near = left[near]
        while place >= 0 and left[place] > near:
            left[place], place = near, left[place]
        return near

    current = count - 1
    while current >= 0:
        taken = [i for i in members[current] if group[i] == current]
        members[current] = []
        for i in taken:
            done[i] = 1
        received: dict[int, int] = {}
        for i in taken:
            near = open_left(i)
            if near >= 0:
                received[near] = received.get(near, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for place, copies in received.items():
            moves.setdefault((copies, group[place]), []).append(place)
        # Most copies first: they end up above those with fewer, next to their old group.
        for copies, old in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            moved = moves[copies, old]
            grown = width[old] + copies * width[current]
            if len(moved) == live[old]:
                width[old] = grown
                continue
            new = len(width)
            width.append(grown)
            members.append(moved)
            live.append(len(moved))
            live[old] -= len(moved)
            below.append(old)
            above.append(above[old])
            below[above[old]] = new  # never past the top: the group at hand is above
            above[old] = new
            for place in moved:
                group[place] = new
        current = below[current]
    return [width[g] for g in group]


def agreement(words: np.ndarray, a: int, b: int) -> int:
    """How many words are equal from places a < b on."""
    total, step, size = 0, 16, len(words)
    while b + total < size:
        end = min(step, size - b - total)
        unlike = words[a + total : a + total + end] != words[b + total : b + total + end]
        if unlike.any():
            return total + int(unlike.argmax())
        total += end
        step *= 2
    return total


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> set[Run]:
    """All runs of a sequence of numbers."""
    letters = np.unique(words, return_inverse=True)[1].reshape(-1)
    size, backwards = len(letters), letters[::-1]
    found: set[Run] = set()
    for ranks in (letters, letters.max() - letters):
        period = np.array(lyndon_array(ranks.tolist()), dtype=np.int64)
        # The first root of a run starts in its first period, so this many are whole.
        roots = (np.maximum(least, times * period) - period + 1) // period
        last = np.arange(size) + (roots - 1) * period
        again = (last < size) & (period[np.minimum(last, size - 1)] == period)
        ends: dict[int, int] = {}  # where the last run of a period ends
        for place in np.flatnonzero(again).tolist():
            q = int(period[place])
            if place + q <= ends.get(q, 0):
                continue  # a later root of the same run
            end = place + q + agreement(letters, place, place + q)
            start = place - agreement(backwards, size - place - q, size - place)
            if end - start >= max(least, times * q):
                ends[q] = end
                found.add((start, end - start, q))
    return found


def stretches(words: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int]]:
    """Parts of a text, as places from and to, that hold all its runs."""
    window = least // times
    if len(words) < least:
        return
    hashes = window_hashes(mix(words.astype(np.uint64) + np.uint64(1)), window)
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    if len(counts) == len(hashes):
        return
    twice = np.concatenate([[False], counts[inverse.reshape(-1)] > 1, [False]])
    turns = np.flatnonzero(twice[1:] != twice[:-1]).tolist()
    for begin, end in zip(turns[::2], turns[1::2], strict=True):
        if end - begin > least - window:
            yield begin, end + window - 1


def text_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """Runs of a text, by start and then period."""
    known: dict[bytes, int] = {}
    numbers = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    found = []
    for begin, end in stretches(numbers, least, times):
        found += [(begin + s, n, q) for s, n, q in runs_of(numbers[begin:end], least, times)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that are left when every run keeps its first period only."""
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
    return b" ".join(words)


def periodic_runs(
    documents: DataFrame, least: int = LEAST, times: int = TIMES, prepare: Prepare | None = None
) -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed), one for each row of ``documents``.

    ``runs`` are structs of start, length and period in words. ``prepare`` may change the words
    of a text, given its doc_id, before runs are looked for. ``times`` is 3 or more.
    """
    if times < 3 or least < times:
        raise ValueError("runs have three periods or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, texts = [], [], []
            for doc_id, data in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), strict=True):
                words = data.tobytes().split()
                if prepare:
                    words = prepare(doc_id, words)
                runs = text_runs(words, least, times)
                sizes.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                texts.append(collapsed(words, runs).decode())
            entry = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(entry)),
                 pa.array(texts, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run,
        "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string",
    )


def with_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The text that the query looks at: of every tenth document the tail repeats a part.

    A document without doc_id stays as it is.
    """
    code = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if code % 10 or not words:
        return words
    seed, size = code // 10, len(words)
    begin = seed % size
    period = 1 + (size - begin) // (3 + seed % 8)
    cycle = words[begin : begin + period]
    tail = cycle * -(-(size - begin) // len(cycle))
    return words[:begin] + tail[: size - begin]


def run_digests(documents: DataFrame) -> DataFrame:
    """Per document: its number of runs, the run of most periods, and digests."""
    runs = periodic_runs(documents, prepare=with_tail)
    # Most periods first, exactly: lengths times the other's period are compared.
    first = F.expr(
        """aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (a, b) -> case
             when a is null or b.length * a.period > a.length * b.period then b else a end)"""
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = runs.withColumn("best", first).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return rows


#: DuckDB form of the query op13_periodic_runs: windows of eight words that come again q words
#: later, in unbroken rows; of equal stretches the smallest period counts.
SQL = """
with step as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) as crc),
t as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words,
    list_transform(string_split(doc_id::varchar, ''), lambda c: unicode(c)::bigint) as b from documents),
h as (
  select doc_id, words, len(words) as n, xor(4294967295, list_reduce(list_concat([4294967295], b),
    lambda x, y: xor(x >> 8, step.crc[(xor(x, y) & 255) + 1]))) as h from t, step),
g as (
  select *, h % 10 = 0 and n > 0 as cyclic, case when n > 0 then (h // 10) % n end as a, (h // 10) % 8 as e from h),
w as (
  select doc_id, n, case when cyclic then list_transform(range(n), lambda i:
      case when i >= a then words[a + (i - a) % (1 + (n - a) // (3 + e)) + 1] else words[i + 1] end)
    else words end as words from g),
grams as (
  select doc_id, i, array_to_string(words[i + 1:i + 8], ' ') as gram
  from (select doc_id, words, unnest(range(n - 7)) as i from w where n >= 24)),
pairs as (
  select a.doc_id, a.i, b.i - a.i as q from grams a join grams b
  on a.doc_id = b.doc_id and a.gram = b.gram and a.i < b.i),
rows as (select *, i - row_number() over (partition by doc_id, q order by i) as island from pairs),
stretch as (
  select doc_id, q, min(i) as start, count(*) + 7 + q as length from rows group by doc_id, q, island
  having count(*) + 7 + q >= greatest(24, 3 * q)),
runs as (select doc_id, start, length, min(q) as period from stretch group by doc_id, start, length),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (
  select doc_id, string_agg(word, ' ' order by i) as text
  from (select doc_id, unnest(words) as word, unnest(range(n)) as i from w) anti join gone using (doc_id, i)
  group by doc_id),
best as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines
  from runs group by doc_id),
firsts as (
  select * from runs qualify row_number() over (
    partition by doc_id order by length::double / period desc, start, period) = 1)
select w.doc_id, coalesce(n_runs, 0)::bigint as n_runs, start, length, period,
  (1000 * length) // period as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
  sha256(coalesce(kept.text, '')) as collapsed_sha256
from w left join best using (doc_id) left join firsts using (doc_id) left join kept using (doc_id)
"""
