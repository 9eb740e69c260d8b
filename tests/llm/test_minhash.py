"""b-bit MinHash groups against all pairs."""

import random
from collections import Counter

import numpy as np

from faultline.llm import bbit_minhash as bm
from faultline.llm.words import mix
from test_pairs import edited, groups


def judged(rows):
    return Counter({(d, n, c, d == c): k for (d, n, c), k in groups(rows, 2, 80).items()})


def found_rows(documents):
    found = bm.minhash_groups(documents)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return Counter(map(tuple, found.collect()))


def test_groups_equal_all_pairs(frame, odd, prose):
    rows = list(odd)
    for family in range(6):
        base = prose(100 + family, 40 + 60 * family)
        rows += [(1000 + 50 * family + k, edited(base, range(3, 3 + 9 * k, 9))) for k in range(12)]
    assert found_rows(frame(rows)) == judged(rows)


def test_short_texts_and_the_exact_threshold(frame):
    rows = [
        (1, "a b c d e"), (2, "a b c d e f"), (3, "a b c d e f g"), (4, "A b"), (5, "a B"), (6, "a"), (7, "A"),
        (8, "b"), (9, "a b a b a b"), (10, "b a b a b"), (11, "  a  b\tc d e "), (12, "p q r s t"),
    ]
    assert found_rows(frame(rows)) == judged(rows)  # 4 of 5 shingles are exactly 80 %


def test_chain_of_neighbours(frame, prose):
    """Texts that link only to the next one; hubs alone would not find every link."""
    base = prose(9, 200)
    rows = [(k, edited(base, range(k * 3, k * 3 + 20))) for k in range(60)]
    assert found_rows(frame(rows)) == judged(rows)


def test_many_copies_and_names(frame, prose):
    text, other = prose(21, 120), prose(22, 90)
    rows = [(500 + k, text) for k in range(400)] + [(k, edited(text, [k])) for k in range(40)]
    rows += [(None, text)] * 30 + [(None, other)] * 5 + [(3000, prose(23, 50))] * 2
    assert found_rows(frame(rows)) == Counter({
        (d, n, c, d == c): k for (d, n, c), k in groups(rows, 2, 80).items()
    })


def test_no_rows(frame):
    assert found_rows(frame([])) == Counter()
    assert found_rows(frame([(4, None), (5, " "), (None, "")])) == Counter(
        {(4, 0, 4, True): 1, (5, 0, 5, True): 1, (None, 0, None, True): 1}
    )


def test_long_words_are_told_apart(frame):
    """Words that a sum modulo 2^64 cannot tell apart."""
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: "b", 98: "a"})
    mirror = word.translate({97: "b", 98: "a"})
    rows = [(1, word), (2, mirror), (3, word[:1024]), (4, mirror[:1024])]
    assert found_rows(frame(rows)) == judged(rows)


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(3)
    off = []
    for shared, own in [(900, 50), (800, 100), (500, 250), (50, 500), (8, 1), (2000, 0)] * 12:
        pool = mix(rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64))
        a, b = np.sort(pool[: shared + own]), np.sort(np.r_[pool[:shared], pool[shared + own :]])
        bits = [np.frombuffer(bm.signature(bm.minima(x)), np.uint64).reshape(bm.BITS, -1) for x in (a, b)]
        off.append(float(bm.similarity(bm.agreeing(*bits))) - shared / (shared + 2 * own))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04 and max(map(abs, off)) < 0.15


def test_bands_meet_at_the_threshold():
    """Pairs at 0.8 share a band; pairs at 0.05 do not."""
    rng = np.random.default_rng(4)
    for _ in range(150):
        size = int(rng.choice([1, 2, 10, 60, 9000]))  # 8 of 10 parts are shared
        pool = mix(rng.integers(0, 1 << 63, 10 * size, dtype=np.uint64))
        a, b = np.sort(pool[: 9 * size]), np.sort(np.r_[pool[: 8 * size], pool[9 * size :]])
        assert np.intersect1d(*[bm.band_keys(bm.minima(x)) for x in (a, b)]).size
        far = np.sort(np.r_[pool[:size], mix(rng.integers(0, 1 << 63, 9 * size, dtype=np.uint64))])
        if size > 2:
            assert np.intersect1d(*[bm.band_keys(bm.minima(x)) for x in (a, far)]).size < 3


def test_minima_do_not_depend_on_slices():
    rng = random.Random(5)
    hashes = np.array([rng.getrandbits(64) for _ in range(20_000)], dtype=np.uint64)
    whole = bm.minima(hashes)
    parts = [bm.minima(hashes[i : i + 999]) for i in range(0, 20_000, 999)]
    assert (whole == np.min(parts, axis=0)).all()
