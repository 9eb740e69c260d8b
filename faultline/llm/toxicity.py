"""Toxicity: passages whose tokens score higher than clean text of that length ever does.

Method
------
A token's score is the log-odds of toxic against clean labelled texts, counted by document,
with Dirichlet priors in levels: the share of a token's first 4 bytes is the prior of its
first 6, that of its first 9, and that of the token. A token never seen thus scores as its
beginning does. ``DRIFT`` is taken off each score, so that clean text falls on average.

A linear-time scan finds all maximal scoring segments of a text: disjoint passages none of
which can be made better by growing or shrinking. In clean text of n tokens the best
segment's score S follows an extreme-value law, P(S >= s) = 1 - exp(-K n exp(-lambda s)):
lambda solves E exp(lambda score) = 1 over clean tokens and K is the most likely value for
clean labelled texts. A segment with K n exp(-lambda s) at most ``EXPECTED`` is significant.
The document's score is a logistic function of the best segment's lambda s - log(K n) and of
the sum of that over the significant ones, fitted on labelled texts that gave no counts.

Learning uses about ``SAMPLE`` labelled documents of each class (all, if there are fewer),
only of those whose crc32(doc_id) mod 5 is not 0. Counts fall into ``BUCKETS`` hash buckets
for each level, so what is broadcast has six megabytes whatever the input.

Cases
-----
Null and empty texts have no token and no passage; they get the lowest score that the
calibration gives to texts without one. With labels of one class or none, scores are the
smoothed share of toxic labels. Rows that repeat a doc_id are scored each by its text. Null
doc_id: never learned from, not held out. Very long texts: read whole; a passage counts the less,
the longer its text. Empty tables: no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.calibration import fit_logistic, held_out, logistic
from faultline.llm.quality_rules import CLASSES, learnable, sampled
from faultline.llm.words import BYTE_VALUES, LOWER, byte_rows, mix, powers, slices

BUCKETS, SAMPLE = 1 << 18, 8_000
LEVELS = (4, 6, 9, 0)  # bytes of a token's beginning; 0: the whole token
PRIOR, DRIFT, EXPECTED = 8.0, 0.5, 0.05


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (letters, digits, bytes of other alphabets; A-Z as a-z): byte places where they
    start, and buckets as an array of (level, token)."""
    starts_of, parts = [np.zeros(0, np.int64)], [np.zeros((len(LEVELS), 0), np.int64)]
    for begin, end in slices(data):
        part = LOWER[data[begin:end]]
        if not len(part):
            continue
        inside = np.concatenate([[False], CLASSES[part] == 1, [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[::2], turns[1::2]
        if not len(starts):
            continue
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[part] * up[: len(part)], out=sums[1:])
        rows = []
        for level, width in enumerate(LEVELS):
            upto = np.minimum(starts + width, ends) if width else ends
            hashes = mix((sums[upto] - sums[starts]) * down[starts] + np.uint64(level))
            rows.append((hashes & np.uint64(BUCKETS - 1)).astype(np.int64))
        starts_of.append(starts + begin)
        parts.append(np.stack(rows))
    return np.concatenate(starts_of), np.concatenate(parts, axis=1)


def class_samples(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, label, part): three quarters (part 0) count, the others calibrate."""
    known = learnable(labels, "toxic")
    both = sampled(known.filter("label > 0"), SAMPLE).unionByName(sampled(known.filter("label = 0"), SAMPLE))
    quarter = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(4))
    return both.select("doc_id", F.least("label", F.lit(1)).alias("label"), (quarter == 0).alias("calibrate"))


def counts(texts: DataFrame) -> np.ndarray:
    """Labelled texts that hold each bucket's token, as an array (class, level, bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, len(LEVELS), BUCKETS), np.int64)
        for batch in batches:
            for label, data in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), strict=True):
                for level, buckets in enumerate(tokens(data)[1]):
                    held[label, level, np.unique(buckets)] += 1
        places = np.flatnonzero(held.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(places), pa.array(held.ravel()[places])], ["place", "n"]
        )

    found = (
        texts.select("label", "text").mapInArrow(run, "place long, n long").groupBy("place")
        .agg(F.sum("n").alias("n")).toArrow()
    )
    out = np.zeros(2 * len(LEVELS) * BUCKETS, np.float32)
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(2, len(LEVELS), BUCKETS)


def token_scores(buckets: np.ndarray, held: np.ndarray, sizes: tuple[float, float]) -> np.ndarray:
    """Scores of tokens: log-odds against an even share of toxic texts, less the drift.

    A token that repeats the one before it is no new evidence and only costs the drift.
    """
    toxic = np.full(buckets.shape[1], 0.5)
    for level in range(len(LEVELS)):
        clean_n, toxic_n = held[0, level, buckets[level]] / sizes[0], held[1, level, buckets[level]] / sizes[1]
        scale = (sizes[0] + sizes[1]) / 2
        toxic = (toxic_n * scale + PRIOR * toxic) / ((clean_n + toxic_n) * scale + PRIOR)
    scores = np.log(toxic / (1 - toxic)) - DRIFT
    scores[1:][buckets[-1, 1:] == buckets[-1, :-1]] = -DRIFT
    return scores


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first token, token after the last).

    Candidates are kept in order with their sums before (low) and after (high) and a link to
    the nearest earlier one that starts lower; each step follows links only, so the scan
    takes time in proportion to the tokens that score above 0.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    low, high, first, last, link = [], [], [], [], []
    for i in np.flatnonzero(scores > 0).tolist():
        a, b, start = float(total[i]), float(total[i + 1]), i
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= a:
                j = link[j]
            if j < 0 or high[j] >= b:
                break
            a, start = low[j], first[j]
            del low[j:], high[j:], first[j:], last[j:], link[j:]
        low.append(a)
        high.append(b)
        first.append(start)
        last.append(i + 1)
        link.append(j)
    return [(h - x, f, e) for x, h, f, e in zip(low, high, first, last, strict=True)]


def clean_law(clean: list[np.ndarray]) -> tuple[float, float]:
    """lambda and K of the extreme-value law, from the token scores of clean texts."""
    clean = [s for s in clean if len(s)]
    if not clean:
        return 1.0, 1.0
    every = np.concatenate(clean)
    grow = lambda rate: float(np.mean(np.exp(np.minimum(rate * every, 60.0)))) - 1
    low, high = 0.0, 1.0
    while grow(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if grow(middle) < 0 else (low, middle)
    rate = max(high, 1e-3)
    best = [max((s for s, _, _ in segments(x)), default=0.0) for x in clean]
    return rate, len(clean) / sum(len(x) * math.exp(-rate * s) for x, s in zip(clean, best, strict=True))


def passages(scores: np.ndarray, law: tuple[float, float]) -> tuple[float, float, list[tuple[float, int, int]]]:
    """Best and summed normalised segment scores, and the significant segments."""
    rate, k = law
    shift = math.log(k * max(1, len(scores)))
    found = [(rate * s - shift, a, b) for s, a, b in segments(scores)]
    best = max((x for x, _, _ in found), default=-shift)
    good = [x for x in found if x[0] >= -math.log(EXPECTED)]
    return best, sum(x for x, _, _ in good), good


def model_inputs(best: float, total: float) -> tuple[float, float]:
    """Past some size more evidence adds little; logs keep long texts comparable."""
    return max(-10.0, min(best, 30.0)), math.log1p(max(0.0, total))


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, n_passages, passages), one for each row of ``documents``.

    ``passages`` lists the byte where each significant passage starts, the byte where its
    last token starts, and its normalised score.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learning = texts.join(F.broadcast(class_samples(labels)), "doc_id")
    held = counts(learning.filter("not calibrate"))
    fit_sizes = dict(
        learning.filter("not calibrate").groupBy("label").count().collect()
    )
    sizes = (float(fit_sizes.get(0, 0)), float(fit_sizes.get(1, 0)))
    known = learnable(labels, "toxic").agg(F.sum((F.col("label") > 0).cast("int")), F.count("*")).first()
    share = ((known[0] or 0) + 1) / (known[1] + 2)
    rows = texts.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    if not (sizes[0] and sizes[1]):
        none = F.lit(None).cast("array<struct<start:long,last:long,score:double>>")
        return rows.select(
            "doc_id", "held_out", F.lit(share).alias("score"), F.lit(0).alias("n_passages"), none.alias("passages")
        )
    table = spark.sparkContext.broadcast((held, sizes))
    law, model = calibration(learning.filter("calibrate"), table, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_counts, class_sizes = table.value
        for batch in batches:
            inputs, lists = [], []
            for data in byte_rows(batch.column(2)):
                starts, buckets = tokens(data)
                best, total, good = passages(token_scores(buckets, held_counts, class_sizes), law)
                inputs.append(model_inputs(best, total))
                lists.append(
                    [{"start": int(starts[a]), "last": int(starts[b - 1]), "score": x} for x, a, b in good]
                )
            best, total = zip(*inputs, strict=True) if inputs else ((), ())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(best, pa.float64()), pa.array(total, pa.float64()),
                    pa.array([len(x) for x in lists], pa.int32()), pa.array(lists, kind),
                ],
                ["doc_id", "held_out", "best", "total", "n_passages", "passages"],
            )

    measured = rows.mapInArrow(
        run,
        "doc_id long, held_out boolean, best double, total double, n_passages int, "
        "passages array<struct<start:long,last:long,score:double>>",
    )
    return measured.select(
        "doc_id", "held_out", logistic(model, ["best", "total"]).alias("score"), "n_passages", "passages"
    )


def calibration(texts: DataFrame, table, share: float) -> tuple[tuple[float, float], dict]:
    """The law of clean texts and the logistic model, from the calibration sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = table.value
        for batch in batches:
            found = [token_scores(tokens(d)[1], held, sizes).astype(np.float32) for d in byte_rows(batch.column(1))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["label", "scores"]
            )

    sample = texts.select("label", "text").mapInArrow(run, "label int, scores array<float>").toArrow()
    labels = sample.column("label").to_numpy()
    lists = sample.column("scores").combine_chunks()
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(float)
    each = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    law = clean_law([x for x, label in zip(each, labels, strict=True) if label == 0])
    inputs = np.array([model_inputs(*passages(x, law)[:2]) for x in each]).reshape(len(each), 2)
    return law, fit_logistic(inputs, labels, share)
