"""Document fingerprints: every shingle hash below a fixed fraction of the hash range.

Method
------
A text's shingles are its distinct runs of ``WORDS`` words (A-Z as a-z); a shorter text is
one shingle. The fingerprint keeps those whose 64-bit hash lies below 1/``SCALE`` of the range,
sorted. What is kept depends on the hash alone, so the fingerprint of a union is the union of
the fingerprints, and the share of a small text's kept hashes that a large text keeps too
estimates its containment, however unequal the two are. A text of which no hash lies below
keeps its least one, so that no text with words has an empty fingerprint.

Likeness of two fingerprints is the containment of the one with fewer hashes in the other.
If one of them has only its least hash, above the bound, the likeness is 1 if it is the
other's least hash too, else 0.

Neighbours in the order of doc_id
---------------------------------
Rows go to buckets of consecutive doc_ids with about equal counts; the first row of a bucket
also goes, as a guard, to the end of the bucket before, so each bucket has the next text for
all of its rows. Texts are shuffled once, and no window spans the table.

Cases
-----
Null and empty texts and texts of white space: empty fingerprint; likeness of two empty ones is 1, of an
empty and another 0. Order: null doc_id first, then by doc_id, then by text. Rows that repeat
a doc_id follow each other. A single row is its own next. Very long texts: read whole; a task holds
two texts at a time besides its batch. Empty tables: no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import shuffle_partitions
from faultline.llm.words import LOWER, byte_rows, shingle_set

WORDS, SCALE = 5, 8
BOUND = np.uint64((1 << 64) // SCALE)


def fingerprint(data: np.ndarray) -> np.ndarray:
    """Sorted kept hashes of a text given as UTF-8 bytes."""
    hashes = shingle_set(LOWER[data], WORDS)
    kept = hashes[: int(np.searchsorted(hashes, BOUND))]
    return kept if len(kept) else hashes[:1]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of the two texts' shingles together."""
    both = np.union1d(a, b)
    kept = both[: int(np.searchsorted(both, BOUND))]
    return kept if len(kept) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a[0] >= BOUND or b[0] >= BOUND:
        return float(a[0] == b[0])
    few = min(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / few


def as_text(kept: np.ndarray) -> str:
    """Sixteen hexadecimal digits a hash."""
    return kept.astype(">u8").tobytes().hex()


def characters(data: np.ndarray) -> np.ndarray:
    """Byte places at which code points start."""
    return np.flatnonzero((data & 0xC0) != 0x80)


def edited(data: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The text with its second half (rounded down) replaced by the start of the next one."""
    own, other = characters(data), characters(following)
    half = len(own) // 2
    end = own[len(own) - half] if half else len(data)
    upto = other[half] if half < len(other) else len(following)
    return np.concatenate([data[:end], following[:upto]])


def in_order(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, text, bucket, place) sorted in buckets; place 1 and 2 mark guards.

    Place 2 is the first row of all, put after the last.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = 2 * shuffle_partitions(documents)
    found = rows.agg(
        F.percentile_approx("doc_id", [i / count for i in range(1, count)], 20 * count), F.min("doc_id"),
        F.count(F.when(F.col("doc_id").isNull(), 1)),
    ).first()
    least = None if found[2] else found[1]
    bounds = np.array(sorted({x for x in found[0] or [] if x != least}), dtype=np.int64)

    @F.pandas_udf("array<struct<bucket:int,place:int>>")
    def places(ids: pd.Series) -> pd.Series:
        out = []
        for doc_id in ids.array:
            null = pd.isna(doc_id)
            bucket = 0 if null else int(np.searchsorted(bounds, doc_id, side="right"))
            own = [{"bucket": bucket, "place": 0}]
            if not null and bucket and bounds[bucket - 1] == doc_id:
                own.append({"bucket": bucket - 1, "place": 1})
            if (null and least is None) or (not null and doc_id == least):
                own.append({"bucket": len(bounds), "place": 2})
            out.append(own)
        return pd.Series(out)

    dealt = rows.withColumn("_at", F.explode(places(F.col("doc_id").cast("string").cast("long"))))
    dealt = dealt.select("doc_id", "text", "_at.bucket", "_at.place")
    return dealt.repartition(count, "bucket").sortWithinPartitions(
        "bucket", "place", F.col("doc_id").asc_nulls_first(), "text"
    )


def with_neighbours(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, both fingerprints and their likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, place, doc_id, text, fingerprint) of the row before
        for batch in batches:
            out = []
            for bucket, place, doc_id, view in zip(
                batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(0).to_pylist(),
                byte_rows(batch.column(1)), strict=True,
            ):
                if place and (last is None or last[0] != bucket or last[1]):
                    continue  # only the first guard after a bucket's own rows is needed
                data = view.copy()
                kept = fingerprint(data)
                if last is not None and last[0] == bucket and not last[1]:
                    changed = edited(last[3], data)
                    other = fingerprint(changed)
                    out.append(
                        (
                            last[2], len(characters(last[3])), hashlib.sha256(changed.tobytes()).hexdigest(),
                            as_text(last[4]), as_text(other), likeness(last[4], other), likeness(last[4], kept),
                        )
                    )
                last = (bucket, place, doc_id, data, kept)
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return in_order(documents).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
