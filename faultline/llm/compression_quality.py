"""Compression classifier: texts that a dictionary of good texts compresses better are good.

Method
------
Two zstandard dictionaries are trained, one on pieces of labelled good texts and one on
pieces of bad ones. Every text is cut into blocks of ``BLOCK`` bytes, each compressed with
either dictionary, so that the dictionaries matter as much at the end of a long text as at its
start. With the sums g and b of the compressed sizes, the text's statistic is (b - g) divided
by the larger of both. Logistic regression on labelled texts that no dictionary saw makes it a
probability; its other input is the log of the share of bytes that compression without a
dictionary leaves, because texts that repeat themselves compress alike with any dictionary.

Learning uses about ``SAMPLE`` labelled documents of each class (all, if there are fewer),
and of each at most ``PIECES`` pieces for the dictionaries. Only labels of documents whose
crc32(doc_id) mod 5 is not 0 are used.

Cases
-----
Null and empty texts get the share of good labels as their score. With labels of one class
or none, all scores are the smoothed share of good labels. Rows that repeat a doc_id are
scored each by its text. Null doc_id: never learned from, not held out. Very long texts: compressed
whole, block by block. Empty tables: no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.calibration import fit_logistic, held_out, logistic
from faultline.llm.quality_rules import learnable, sampled
from faultline.llm.words import byte_rows

BLOCK, LEVEL = 2048, 3
SAMPLE, PIECES, DICTIONARY = 2_000, 4, 112 * 1024


def class_samples(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, label, fit): ``fit`` tells whether a dictionary may see the text."""
    known = learnable(labels, "quality")
    both = sampled(known.filter("label > 0"), SAMPLE).unionByName(sampled(known.filter("label = 0"), SAMPLE))
    return both.select(
        "doc_id", F.least("label", F.lit(1)).alias("label"),
        (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)) == 0).alias("fit"),
    )


def pieces(texts: DataFrame) -> pa.Table:
    """At most ``PIECES`` blocks, evenly spread, of each text: rows (doc_id, label, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, found = [], [], []
            for doc_id, label, data in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_rows(batch.column(2)), strict=True
            ):
                count = -(-len(data) // BLOCK)
                for i in sorted({k * count // PIECES for k in range(PIECES)} if count else ()):
                    ids.append(doc_id)
                    labels.append(label)
                    found.append(data[i * BLOCK : (i + 1) * BLOCK].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(found, pa.binary())],
                ["doc_id", "label", "piece"],
            )

    return texts.select("doc_id", "label", "text").mapInArrow(
        run, "doc_id long, label int, piece binary"
    ).toArrow()


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples, the samples themselves."""
    total = sum(map(len, samples))
    try:
        size = max(1024, min(DICTIONARY, total // 4))
        return zstandard.train_dictionary(size, samples, level=LEVEL, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def measured(table: DataFrame, good: bytes, bad: bytes, carry: list[str]) -> DataFrame:
    """``carry`` and, of the text in ``table``: difference, plain (null: no text)."""
    types = [table.schema[c].dataType.simpleString() for c in carry]
    schema = ", ".join(f"{c} {t}" for c, t in zip(carry, types, strict=True))
    width = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = []
        for content in (good, bad):
            trained = zstandard.ZstdCompressionDict(content)
            trained.precompute_compress(level=LEVEL)
            tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False))
        tools.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
        for batch in batches:
            difference, plain = [], []
            for data in byte_rows(batch.column(width)):
                if not len(data):
                    difference.append(None)
                    plain.append(None)
                    continue
                blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
                g, b, own = (sum(len(t.compress(x)) for x in blocks) for t in tools)
                difference.append((b - g) / max(b, g))
                plain.append(math.log(own / len(data)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(width)]
                + [pa.array(difference, pa.float64()), pa.array(plain, pa.float64())],
                names=[*carry, "difference", "plain"],
            )

    return table.select(*carry, "text").mapInArrow(run, f"{schema}, difference double, plain double")


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, difference, plain), one for each row of ``documents``."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = class_samples(labels)
    learning = texts.join(F.broadcast(chosen), "doc_id")
    found = pieces(learning.filter("fit")).sort_by([("doc_id", "ascending"), ("piece", "ascending")])
    by_class = {
        k: [p for p, x in zip(found.column("piece").to_pylist(), found.column("label").to_pylist(), strict=True) if x == k]
        for k in (0, 1)
    }
    shares = learnable(labels, "quality").agg(
        F.sum(F.when(F.col("label") > 0, 1).otherwise(0)), F.count("*")
    ).first()
    share = ((shares[0] or 0) + 1) / (shares[1] + 2)
    rows = texts.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    if not (by_class[0] and by_class[1]):
        return rows.select(
            "doc_id", "held_out", F.lit(share).alias("score"),
            F.lit(None).cast("double").alias("difference"), F.lit(None).cast("double").alias("plain"),
        )
    good, bad = dictionary(by_class[1]), dictionary(by_class[0])
    fitted = measured(learning.filter("not fit"), good, bad, ["label"]).filter("plain is not null").toArrow()
    inputs = np.column_stack([fitted.column("difference").to_numpy(), fitted.column("plain").to_numpy()])
    label = fitted.column("label").to_numpy()
    model = fit_logistic(inputs, label, share)
    score = F.coalesce(logistic(model, ["difference", "plain"]), F.lit(share))
    return measured(rows, good, bad, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", score.alias("score"), "difference", "plain"
    )
