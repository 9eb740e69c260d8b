"""The compression classifier against a plain loop over both dictionaries and the fit."""

import math
import random
import zlib

import numpy as np
import pytest
import zstandard

from faultline.llm import compression_quality as cq


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def rows(prose):
    """Good texts are prose; bad ones share their letters but not their words."""
    rng = random.Random(11)
    out = []
    for i in range(240):
        text = prose(3000 + i, 120 + 5 * (i % 40))
        if i % 2:
            text = " ".join("".join(rng.sample(w, len(w))) + rng.choice(["", "#", "zq"]) for w in text.split(" "))
        out.append((i, text))
    return [*out, (900, ""), (901, None)]


def blocks(text):
    data = (text or "").encode()
    return [data[i : i + 2048] for i in range(0, len(data), 2048)]


def trained(texts):
    """Four blocks, evenly spread, of each text, in the order of doc_id and block."""
    samples = []
    for text in texts:
        parts = blocks(text)
        samples += sorted(parts[i] for i in {k * len(parts) // 4 for k in range(4)} if parts)
    size = max(1024, min(112 * 1024, sum(map(len, samples)) // 4))
    return zstandard.train_dictionary(size, samples, level=3, threads=0)


def statistics(text, good, bad):
    sizes = []
    for dictionary in (good, bad, None):
        extra = {"dict_data": dictionary} if dictionary else {}
        tool = zstandard.ZstdCompressor(level=3, write_content_size=False, **extra)
        sizes.append(sum(len(tool.compress(part)) for part in blocks(text)))
    g, b, own = sizes
    return (b - g) / max(g, b), math.log(own / len(text.encode()))


def logistic(inputs, labels, share):
    """Minimum of the weighted log loss with a ridge, by many small steps of gradient descent."""
    mean, scale = inputs.mean(axis=0), inputs.std(axis=0) + 1e-12
    x = np.column_stack([(inputs - mean) / scale, np.ones(len(labels))])
    mass = np.where(labels == 1, share / labels.sum(), (1 - share) / (len(labels) - labels.sum())) * len(labels)
    penalty, weights = np.array([1.0] * inputs.shape[1] + [1e-6]), np.zeros(inputs.shape[1] + 1)
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-x @ weights))
        weights -= 0.01 * (x.T @ (mass * (p - labels)) + penalty * weights)
    return lambda values: 1 / (1 + math.exp(-float(np.append((np.array(values) - mean) / scale, 1) @ weights)))


@pytest.fixture(scope="module")
def both(spark, rows):
    """Scores of the module and of the loop."""
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = {i: int(i % 2 == 0) for i, _ in rows if i < 900}
    table = spark.createDataFrame([(i, y, 0) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in cq.scores(frame, table).collect()}
    # Which labelled texts the dictionaries may see is decided by a hash of Spark.
    fit = {r.doc_id for r in cq.class_samples(table).collect() if r.fit}
    learned = [i for i in labels if not held(i)]
    assert {r.doc_id for r in cq.class_samples(table).collect()} == set(learned)
    texts = dict(rows)
    good, bad = (trained([texts[i] for i in sorted(fit) if labels[i] == y]) for y in (1, 0))
    rest = [i for i in learned if i not in fit]
    inputs = np.array([statistics(texts[i], good, bad) for i in rest])
    share = (sum(labels[i] for i in learned) + 1) / (len(learned) + 2)
    model = logistic(inputs, np.array([labels[i] for i in rest], float), share)
    scores = {i: model(statistics(t, good, bad)) if t else share for i, t in rows}
    return found, scores, labels


def test_scores_equal_the_loop(both):
    found, scores, _ = both
    for doc_id, score in scores.items():
        assert found[doc_id].score == pytest.approx(score, abs=1e-5)
        assert found[doc_id].held_out == held(doc_id)


def test_the_difference_alone_tells_the_classes(both):
    found, _, labels = both
    tested = [i for i in labels if held(i)]
    right = np.mean([(found[i].difference > 0) == (labels[i] == 1) for i in tested])
    assert right >= 0.95
    assert np.mean([(found[i].score >= 0.3) == (labels[i] == 1) for i in tested]) >= 0.95
