"""Substring dedup: word runs that occur earlier in the corpus, and texts without them.

Method
------
A window of ``width`` words is an edge of a De Bruijn graph: it leads from its first
``width - 1`` words to its last. An edge is repeated if the corpus holds it twice.

1. Copies of a whole text are one *node*; only its first text is searched further.
2. Anchors: of every ``width - ANCHOR + 1`` neighbouring runs of ``ANCHOR`` words, those
   with the least hash. Equal windows have equal anchors at equal places, so a window can
   only be repeated if its anchors are. An eighth of the positions is shuffled, and only
   texts with a repeated anchor are read again.
3. Edges at repeated anchors meet by their 128-bit hash; each learns the coordinates
   (doc_id, text, start) of its first occurrence, its source. A text is given by its rank
   among those of its doc_id, a small number that shuffles well.
4. Compaction: neighbouring repeated edges of a text whose sources are neighbours too, in
   one text, form a nonbranching path. Where the source changes, the graph branches and
   the path ends. A path is one row with the coordinates of its copy and of its source;
   the words that it covers are the span to remove.
5. Spans join their texts.

A task first meets equal edges or anchors among its own rows and sends each once, so that
a passage of a third of all texts is a row for each batch, not for each text.

Cases
-----
Null, empty and short texts hold no window and stay. ``Earlier`` is by doc_id (null first),
then by a hash of the text for rows that share a doc_id, then by start. Rows that repeat
both doc_id and text are one document: both stay, or both lose the same words. Empty tables
give no rows. Very long texts: read whole, in slices. Columns other than doc_id and text are
carried along by ``without_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.tables import left_out, stored, surely_without, thinned
from faultline.llm.words import as_long, byte_rows, mix, spans, window_hashes, word_hashes

#: Words of an anchor. Longer anchors repeat less by chance but leave fewer to choose from.
ANCHOR = 6


def identified(documents: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), ref (finds a text again, also without doc_id), text."""
    doc_id, key = F.col("doc_id").cast("long"), F.xxhash64("text")
    return documents.select(
        doc_id.alias("doc_id"), key.alias("key"), F.coalesce(doc_id, key).alias("ref"), "text"
    )


def summaries(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, key, ref, n_words, sha256 of its words joined by spaces, and the
    128-bit and 64-bit names of its words (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, nodes = [], [], []
            for data in byte_rows(batch.column(3)):
                words = data.tobytes().split()
                counts.append(len(words))
                hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
                nodes.append(name(words) if words else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64()),
                    pa.array(hashes, pa.string()), pa.array(nodes, pa.binary()),
                    pa.array([n and short(n) for n in nodes], pa.int64()),
                ],
                ["doc_id", "key", "ref", "n_words", "sha256", "node", "short"],
            )

    return identified(documents).mapInArrow(
        run, "doc_id long, key long, ref long, n_words long, sha256 string, node binary, short long"
    )


def name(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def short(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest value of every run of ``width`` values, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the anchors of a text."""
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = window_hashes(words, ANCHOR)
    choice = width - ANCHOR + 1
    least = sliding(hashes, choice, np.minimum)
    padded = np.concatenate([np.zeros(choice - 1, np.uint64), least, np.zeros(choice - 1, np.uint64)])
    places = np.flatnonzero(sliding(padded, choice, np.maximum) == hashes)
    return hashes[places], places


def anchor_rows(documents: DataFrame, width: int) -> DataFrame:
    """Rows (anchor, short, place, known): anchors of each text, by a 64-bit name of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, seen = [], set()
            for data in byte_rows(batch.column(0)):
                own = short(name(data.tobytes().split()))
                if own in seen:
                    continue
                seen.add(own)
                hashes, places = anchors(word_hashes(data), width)
                if len(hashes):
                    parts.append((hashes, np.full(len(hashes), own, np.int64), places))
            if not parts:
                continue
            hashes, shorts, places = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            hashes, shorts, places = hashes[order], shorts[order], places[order]
            again = np.zeros(len(hashes), bool)
            again[1:] = hashes[1:] == hashes[:-1]
            known = again.copy()
            known[:-1] |= again[1:]
            # What has met its like here need not meet others: it goes anywhere.
            hashes = np.where(again, mix(shorts.view(np.uint64) + places.astype(np.uint64)), hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(hashes)), pa.array(shorts), pa.array(places.astype(np.int32)), pa.array(known)],
                ["anchor", "short", "place", "known"],
            )

    return documents.select("text").mapInArrow(
        run, "anchor long, short long, place int, known boolean"
    )


def edge_rows(texts: DataFrame, width: int) -> DataFrame:
    """Rows (h1, h2, doc_id, nth, start, length, known) of windows at repeated anchors.

    A known row is a run of ``length`` windows that occur earlier in the same batch. Windows
    are many: rows are kept small, so they have no second hash of their text (``key``).
    """
    reach = width - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, nths = (batch.column(k).to_pylist() for k in range(3))
            rows, places = byte_rows(batch.column(3)), batch.column(4)
            order = sorted(range(len(rows)), key=lambda i: (ids[i] is not None, ids[i] or 0, keys[i]))
            parts, seen = [], set()
            for i in order:
                if (ids[i], keys[i]) in seen:
                    continue
                seen.add((ids[i], keys[i]))
                words = word_hashes(rows[i])
                count = len(words) - width + 1
                if count <= 0:
                    continue
                marks = np.zeros(count + width + 1, np.int32)
                at = np.asarray(places[i].values.to_numpy(zero_copy_only=False), dtype=np.int64)
                np.add.at(marks, np.clip(at - reach, 0, count), 1)
                np.add.at(marks, np.clip(at + 1, 0, count), -1)
                starts = np.flatnonzero(np.cumsum(marks[:count]) > 0)
                if len(starts):
                    parts.append(
                        (
                            window_hashes(words, width, 11)[starts], window_hashes(words, width, 12)[starts],
                            np.full(len(starts), i, np.int64), starts,
                        )
                    )
            if not parts:
                continue
            h1, h2, owner, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            group = np.lexsort((h2, h1))  # stable: the first of equals is the earliest
            again = np.zeros(len(h1), bool)
            a, b = group[1:], group[:-1]
            again[a] = (h1[a] == h1[b]) & (h2[a] == h2[b])
            head = again.copy()
            head[1:] &= ~(again[:-1] & (owner[1:] == owner[:-1]) & (start[1:] == start[:-1] + 1))
            tail = np.flatnonzero(again & ~np.concatenate([again[1:] & ~head[1:], [False]]))
            head = np.flatnonzero(head)
            fresh = np.flatnonzero(~again)
            pick = np.concatenate([fresh, head])
            length = np.concatenate([start[fresh], start[tail]]) + 1 - start[pick]
            known = np.zeros(len(pick), bool)
            known[len(fresh) :] = True
            spread = mix(start[pick].astype(np.uint64) + numbers_of(keys, owner[pick]))
            own = owner[pick].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(as_long(np.where(known, spread, h1[pick]))),
                    pa.array(as_long(np.where(known, spread, h2[pick]))),
                    pa.array([ids[i] for i in own], pa.int64()),
                    pa.array([nths[i] for i in own], pa.int64()),
                    pa.array(start[pick].astype(np.int32)),
                    pa.array(length.astype(np.int32)),
                    pa.array(known),
                ],
                ["h1", "h2", "doc_id", "nth", "start", "length", "known"],
            )

    return texts.select("doc_id", "key", "nth", "text", "places").mapInArrow(
        run, "h1 long, h2 long, doc_id long, nth long, start int, length int, known boolean"
    )


def numbers_of(keys: list[int], owner: np.ndarray) -> np.ndarray:
    return np.array(keys, dtype=np.int64).view(np.uint64)[owner]


def repeated_spans(documents: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Paths of repeated windows: (ref, key, starts, stops), one row for each text with any.

    Windows from starts[i] up to, not including, stops[i] occur earlier. ``rows`` holds the
    ``summaries``. Later copies of a whole text are not listed.
    """
    same = Window.partitionBy("anchor")
    place = F.struct("short", "place")
    repeated = (
        anchor_rows(documents, width)
        .withColumn("_lo", F.min(place).over(same))
        .withColumn("_hi", F.max(place).over(same))
        .filter("known or _lo != _hi")
        .groupBy("short")
        .agg(F.collect_list("place").alias("places"))
    )
    firsts = rows.filter(F.col("n_words") >= width).groupBy("node", "short")
    firsts = firsts.agg(F.min(F.struct("doc_id", "key", "ref")).alias("f")).select("short", "f.*")
    # Texts of one doc_id are told apart by their rank; without doc_id, by the hash as before.
    of_id = F.row_number().over(Window.partitionBy("ref", F.col("doc_id").isNull()).orderBy("key"))
    firsts = firsts.withColumn("nth", F.when(F.col("doc_id").isNull(), F.col("key")).otherwise(of_id.cast("long")))
    wanted = stored(firsts.join(repeated, "short").select("ref", "key", "nth", "places"), "anchored")
    texts = thinned(identified(documents), wanted, "ref").join(wanted, ["ref", "key"])

    edge, copy = Window.partitionBy("h1", "h2"), F.struct("doc_id", "nth", "start")
    edges = edge_rows(texts, width).withColumn("source", F.min(copy).over(edge))
    edges = edges.filter(F.col("known") | (F.col("source") != copy)).drop("h1", "h2")
    along = Window.partitionBy("doc_id", "nth").orderBy("start", "length")
    before = F.lag(F.struct("start", "length", "known", "source")).over(along)
    goes_on = (
        ~F.col("known")
        & ~before["known"]
        & (before["start"] + before["length"] == F.col("start"))
        & before["source"]["doc_id"].eqNullSafe(F.col("source.doc_id"))
        & (before["source"]["nth"] == F.col("source.nth"))
        & (before["source"]["start"] + 1 == F.col("source.start"))
    )
    paths = (
        edges.withColumn("_new", F.when(goes_on, 0).otherwise(1))
        .withColumn("_path", F.sum("_new").over(along))
        .groupBy("doc_id", "nth", "_path")
        .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("stop"))
    )
    listed = paths.groupBy("doc_id", "nth").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")
    )
    listed = listed.select(F.coalesce("doc_id", "nth").alias("ref"), "nth", "starts", "stops")
    return listed.join(wanted.select("ref", "nth", "key"), ["ref", "nth"]).select("ref", "key", "starts", "stops")


def covered(count: int, starts, stops, width: int) -> np.ndarray:
    """Which of ``count`` words lie in a window that starts in one of the ranges."""
    marks = np.zeros(count + 1, np.int64)
    np.add.at(marks, np.minimum(np.asarray(starts, np.int64), count), 1)
    np.add.at(marks, np.minimum(np.asarray(stops, np.int64) - 1 + width, count), -1)
    return np.cumsum(marks[:count]) > 0


def later_copies(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with ``copy``: whether all words of the row occur in an earlier text."""
    firsts = rows.filter(F.col("n_words") >= width).groupBy("node")
    # Stored, so that Spark can split the join where one text has very many copies.
    firsts = stored(firsts.agg(F.min(F.struct("doc_id", "key")).alias("_first")), "firsts")
    long = rows.filter(F.col("n_words") >= width).join(firsts, "node")
    long = long.withColumn("copy", F.struct("doc_id", "key") != F.col("_first")).drop("_first")
    brief = rows.filter(F.col("n_words") < width).withColumn("copy", F.lit(False))
    return long.unionByName(brief)


def dedup_digests(documents: DataFrame, width: int = 20) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), one for each row of ``documents``."""
    rows = stored(summaries(documents), "summaries")
    spans_of = stored(repeated_spans(documents, rows, width), "spans")
    texts = thinned(identified(documents), spans_of, "ref").join(spans_of, ["ref", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, hashes = [], []
            for data, starts, stops in zip(
                byte_rows(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True
            ):
                words = data.tobytes().split()
                gone = covered(len(words), starts, stops, width)
                removed.append(int(gone.sum()))
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                hashes.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())],
                ["ref", "key", "gone", "kept"],
            )

    cut = texts.select("ref", "key", "text", "starts", "stops").mapInArrow(
        run, "ref long, key long, gone long, kept string"
    )
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        later_copies(rows, width)
        .join(cut.distinct(), ["ref", "key"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
            F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
        )
    )


def cut_text(data: np.ndarray, starts, stops, width: int) -> bytes:
    """The text without the covered words; what is left keeps its own white space."""
    first, last = spans(data)
    gone = covered(len(first), starts, stops, width)
    if gone.all():
        return b""
    turns = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    pieces = [data[first[a] : last[b - 1]].tobytes() for a, b in zip(turns[::2], turns[1::2], strict=True)]
    return b" ".join(pieces)


def without_repeats(documents: DataFrame, width: int = 20) -> DataFrame:
    """``documents`` without words that repeat earlier ones; texts left empty are dropped.

    Runs of kept words keep their white space and are joined by a space. ``n_chars``, if
    there, is counted anew.
    """
    rows = stored(summaries(documents), "summaries")
    spans_of = stored(repeated_spans(documents, rows, width), "spans")
    copies = later_copies(rows, width).filter("copy").select("ref", "key").distinct()

    @F.pandas_udf("string")
    def cut(texts, starts, stops):
        import pandas as pd

        return pd.Series(
            [
                cut_text(np.frombuffer(t.encode(), np.uint8), a, b, width).decode()
                if a is not None and t is not None
                else t
                for t, a, b in zip(texts, starts, stops, strict=True)
            ],
            dtype=object,
        )

    packed = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"),
        F.xxhash64("text").alias("key"),
    ).withColumn("ref", F.coalesce(F.col("_row.doc_id").cast("long"), "key"))
    touched = stored(spans_of.select("ref").union(copies.select("ref")).distinct(), "touched")
    left = left_out(thinned(packed, touched, "ref"), copies, ["ref", "key"])
    left = left.join(spans_of, ["ref", "key"], "left").withColumn("_text", cut("_row.text", "starts", "stops"))
    whole = surely_without(packed, touched, "ref").withColumn("_text", F.col("_row.text"))
    out = left.unionByName(whole, allowMissingColumns=True)
    out = out.filter("starts is null or _text != ''")
    columns = []
    for c in documents.columns:
        value = F.col(f"_row.`{c}`")
        if c == "text":
            value = F.col("_text")
        elif c == "n_chars":
            value = F.when(F.col("starts").isNull(), value).otherwise(F.length("_text"))
        columns.append(value.cast(documents.schema[c].dataType).alias(c))
    return out.select(*columns)


#: DuckDB form of the query op6_substring_dedup.
SQL = """
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
k as (
  select doc_id, unnest(range(1, len(words) - 18)) as start,
    unnest(list_transform(range(1, len(words) - 18), lambda i: md5(array_to_string(words[i:i + 19], ' ')))) as h
  from w where len(words) >= 20),
f as (select *, row_number() over (partition by h order by doc_id, start) > 1 as again from k),
c as (
  select distinct doc_id, unnest(range(start, start + 20)) as place from f where again),
p as (
  select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from w),
t as (
  select p.doc_id, count(*) as n, string_agg(word, ' ' order by p.place) as kept
  from p anti join c on c.doc_id = p.doc_id and c.place = p.place group by 1)
select w.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(t.n, 0))::bigint as n_removed,
  sha256(coalesce(t.kept, '')) as kept_sha256
from w left join t on t.doc_id = w.doc_id
"""
