"""Quality rules: a hashed n-gram likelihood ratio against trusted texts, and base counts.

Method
------
Tokens are runs of letters and digits and runs of other signs, case kept. Tokens and token
pairs fall into ``BUCKETS`` hash buckets. Two multinomials over the buckets are counted: one
over all documents, one over trusted ones; both are smoothed by the first. A document's
verdict is the mean, over its n-grams, of the log of trusted over raw probability, and it
stays if that is at least ``THRESHOLD``. Every document is judged, none is drawn at random.

Trusted documents are all labelled ones of quality 1 whose crc32(doc_id) mod 5 is not 0. A bitmap
of fixed size of their ids tells most others, which are counted where they lie; rows that may be
trusted meet their labels in a join. The raw counts are over all documents. A task adds up its own
buckets, so at most ``BUCKETS`` rows leave it, and the table of weights has half a megabyte
whatever the input.

Cases
-----
Null, empty and blank texts have no words and fail the base rule. Without trusted documents
all weights are 0 and only the base rule decides. Labels that are null or of unknown
documents do not count; if a doc_id has several labels the highest counts. Rows that repeat
a doc_id are judged each by its text. Null doc_id: never trusted. Very long texts: read whole,
in slices. Empty tables: no rows. Other columns are not read by ``judged``, whatever their names;
``keepers`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import stored, surely_without, thinned
from faultline.llm.words import (
    BYTE_VALUES, SPACE, byte_rows, mix, powers, slices, window_hashes, word_hashes,
)

BUCKETS = 1 << 16
THRESHOLD = -0.25
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; percent

# 0 white space, 1 letters, digits and bytes of other alphabets, 2 other signs.
CLASSES = np.full(256, 2, np.uint8)
CLASSES[SPACE] = 0
for _first, _last in ((48, 57), (65, 90), (97, 122), (95, 95), (128, 255)):
    CLASSES[_first : _last + 1] = 1
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def token_hashes(data: np.ndarray) -> np.ndarray:
    """One hash for each token of a text."""
    parts = []
    for begin, end in slices(data):
        part = data[begin:end]
        if not len(part):
            continue
        kinds = CLASSES[part]
        turns = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1], [True]]))
        starts, ends = turns[:-1], turns[1:]
        words = kinds[starts] != 0
        starts, ends = starts[words], ends[words]
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[part] * up[: len(part)], out=sums[1:])
        parts.append(mix((sums[ends] - sums[starts]) * down[starts]))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def ngram_buckets(data: np.ndarray) -> np.ndarray:
    """Buckets of the tokens and token pairs of a text."""
    tokens = token_hashes(data)
    pairs = window_hashes(tokens, 2, 21)
    return (np.concatenate([tokens, pairs]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def learnable(labels: DataFrame, column: str) -> DataFrame:
    """Rows (doc_id, label) that may be learned from; one for each doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    rows = rows.filter("doc_id is not null and label is not null")
    rows = rows.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def sampled(rows: DataFrame, bound: int, salt: int = 91) -> DataFrame:
    """About ``bound`` rows by a hash of doc_id; all rows if there are no more."""
    total = rows.count()
    if total <= bound:
        return rows
    slot = F.xxhash64(F.lit(salt), "doc_id").bitwiseAND((1 << 40) - 1)
    return rows.filter(slot < int((1 << 40) * bound / total))


def weights(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log of trusted over raw probability of each bucket."""
    trusted = stored(learnable(labels, "quality").filter("label = 1").select("doc_id"), "trusted")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = trusted.withColumn("trusted", F.lit(True))
    marked = thinned(rows, trusted, "doc_id").join(marks, "doc_id", "left").select("text", "trusted")
    others = surely_without(rows, trusted, "doc_id").select("text", F.lit(None).cast("boolean").alias("trusted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            rows = byte_rows(batch.column(0))
            for data, known in zip(rows, batch.column(1).to_pylist(), strict=True):
                counts = np.bincount(ngram_buckets(data), minlength=BUCKETS) if len(data) > BUCKETS else None
                found = None if counts is not None else ngram_buckets(data)
                for into in (raw, good) if known else (raw,):
                    if counts is not None:
                        into += counts
                    else:
                        np.add.at(into, found, 1)
        held = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array(raw[held]), pa.array(good[held])], ["bucket", "raw", "good"]
        )

    counts = (
        marked.union(others)
        .mapInArrow(run, "bucket long, raw long, good long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
        .toArrow()
    )
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts.column("bucket").to_numpy()
    raw[at], good[at] = counts.column("raw").to_numpy(), counts.column("good").to_numpy()
    if not good.sum():
        return np.zeros(BUCKETS)
    base = (raw + 1) / (raw.sum() + BUCKETS)
    # The trusted counts are smoothed by one raw n-gram a bucket on average.
    return np.log((good + BUCKETS * base) / (good.sum() + BUCKETS)) - np.log(base)


def repeated_words(words: np.ndarray) -> int:
    """Words that lie in a run of three words which the text holds twice or more."""
    windows = window_hashes(words, 3)
    if len(windows) < 2:
        return 0
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : shift + len(twice)] |= twice
    return int(inside.sum())


def duplicate_lines(data: np.ndarray) -> int:
    seen, again = set(), 0
    for line in data.tobytes().split(b"\n"):
        if line and not line.isspace():
            again += line in seen
            seen.add(line)
    return again


def facts(data: np.ndarray, weight: np.ndarray) -> tuple[int, int, int, int, int, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and llr of a text."""
    words = word_hashes(data)
    grams = ngram_buckets(data)
    return (
        len(words),
        int(np.count_nonzero(~SPACE[data] & ((data & 0xC0) != 0x80))),
        int(np.count_nonzero(SYMBOLS[data])),
        duplicate_lines(data),
        repeated_words(words),
        float(weight[grams].mean()) if len(grams) else 0.0,
    )


def fails(n_words, n_repeat_words):
    """The base rule, on columns or numbers."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def judged(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, key, the base counts, base_failed, llr and kept.

    ``key`` is the hash of the text, which tells rows of one doc_id apart.
    """
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast(weights(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = table.value
        for batch in batches:
            out = [facts(data, weight) for data in byte_rows(batch.column(2))]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)]
                + [pa.array(c, pa.int64()) for c in columns[:5]]
                + [pa.array(columns[5], pa.float64())],
                names=["doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"],
            )

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text"
    ).mapInArrow(
        run,
        "doc_id long, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, llr double",
    )
    failed = fails(F.col("n_words"), F.col("n_repeat_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def keepers(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that ``judged`` keeps, with all their columns.

    A text is judged where it lies: only the verdict comes back, and no row is shuffled for it.
    """
    table = documents.sparkSession.sparkContext.broadcast(weights(documents, labels))

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        kept = []
        for data in byte_rows(texts):
            n_words, *_, n_repeat_words, llr = facts(data, table.value)
            kept.append(not fails(n_words, n_repeat_words) and llr >= threshold)
        return pa.array(kept, pa.bool_())

    return documents.filter(good("text"))
