"""Near copies and repeated passages against plain loops."""

import glob
import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm.jaccard_join import bands, jaccard_groups, one_of_each, part_keys, set_keys, spare
from faultline.llm.substring_dedup import anchors, dedup_digests, edge_rows, identified, without_repeats
from faultline.llm.words import window_hashes, word_hashes

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
LOWER = {code: code + 32 for code in range(65, 91)}


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def groups(rows, width, percent):
    """(doc_id, size, component) of each row by comparing all pairs."""
    sets = [shingles(text, width) for _, text in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= percent * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id))
    return Counter(out)


def edited(text, places):
    words = text.split(" ")
    for i in places:
        words[i % len(words)] = f"new{i}"
    return " ".join(words)


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_groups_equal_all_pairs(frame, odd, prose, width, percent):
    rows = list(odd)
    for family in range(6):
        base = prose(100 + family, 40 + 60 * family)
        rows += [(1000 + 50 * family + k, edited(base, range(3, 3 + 9 * k, 9))) for k in range(12)]
    found = jaccard_groups(frame(rows), width, percent)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, found.collect())) == groups(rows, width, percent)


def test_large_family_chains(frame, prose):
    """Each text is near its neighbour only; blocks and rounds must not lose the chain."""
    base = prose(9, 200)
    rows = [(k, edited(base, range(k * 3, k * 3 + 20))) for k in range(60)]
    assert Counter(map(tuple, jaccard_groups(frame(rows)).collect())) == groups(rows, 4, 85)


def test_empty_table(frame):
    assert jaccard_groups(frame([])).count() == 0
    assert dedup_digests(frame([])).count() == 0
    assert without_repeats(frame([])).count() == 0


def test_near_sets_share_a_part():
    rng = np.random.default_rng(4)
    for size in [*range(1, 40), 100, 333, 1000]:
        for _ in range(20):
            whole = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
            other = size + int(rng.integers(0, size * 15 // 85 + 1))
            least = -(-85 * (size + other) // 185)
            if least > size:
                continue
            a = np.sort(whole[:size])
            b = np.sort(np.concatenate([a[rng.permutation(size)[:least]], whole[size : size + other - least]]))
            tiles = bands(85, other)
            assert set(set_keys(a, 85, tiles).tolist()) & set(set_keys(b, 85, tiles).tolist())


def test_empty_parts_have_keys():
    few = np.sort(np.random.default_rng(1).integers(0, 1 << 20, 8, dtype=np.uint64))  # all in part 0
    last = 13
    differ = last * 15 // 85
    assert len(part_keys(few, 3, last, 85)) == differ + 1 + spare(differ)


def test_one_of_each(frame, prose):
    near = prose(20, 100)
    rows = [(5, near), (3, edited(near, [50])), (4, prose(21, 100)), (None, prose(22, 100)), (7, ""), (8, None),
            (4, prose(21, 100)), (3, edited(near, [50]))]
    kept = one_of_each(frame(rows))
    assert kept.columns == frame(rows).columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    want = [(3, edited(near, [50])), (4, prose(21, 100)), (None, prose(22, 100)), (7, ""), (8, None)]
    assert got == sorted((str(i), t or "") for i, t in want)


def test_one_of_each_tells_texts_of_one_id_apart(frame, prose):
    near, other, nameless = prose(23, 100), prose(24, 100), prose(25, 100)
    rows = [(1, near), (5, edited(near, [50])), (5, other), (6, prose(26, 100)), (6, prose(27, 100)),
            *[(None, nameless)] * 40, *[(None, edited(nameless, [i])) for i in (3, 50)], (None, near)]
    got = [(r.doc_id, r.text) for r in one_of_each(frame(rows)).collect()]
    want = {(1, near), (5, other), (6, prose(26, 100)), (6, prose(27, 100))}
    assert {x for x in got if x[0] is not None} == want and len(got) == 5
    assert [t for i, t in got if i is None][0] in {nameless, edited(nameless, [3]), edited(nameless, [50])}


def test_work_tables_of_the_join_are_deleted(spark, frame, prose):
    """Sets and links serve the join only; what stays has a row for each document at most."""
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/faultline/*"))
    base = prose(27, 90)
    left = one_of_each(frame([(k, edited(base, [k])) for k in range(4)]))
    after = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/faultline/*")) - before
    names = {os.path.basename(f).rsplit("-", 1)[0] for f in after}
    assert names == {"llm-profiles", "llm-roots", "llm-groups", "llm-twice"}
    assert [r.doc_id for r in left.collect()] == [0]


def repeats(rows, width=20):
    """(doc_id, words, removed, sha256) and kept words; rows of one doc_id and text are one."""
    seen, out, kept = {}, [], []
    order = sorted({r for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    results = {}
    for doc_id, text in order:
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - width + 1):
            window = b" ".join(words[s : s + width])
            if window in seen:
                gone.update(range(s, s + width))
            seen.setdefault(window, (doc_id, text))
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        results[doc_id, text] = (doc_id, len(words), len(gone), hashlib.sha256(left).hexdigest())
        kept.append((doc_id, left, bool(words)))
    for row in rows:
        out.append(results[row])
    return Counter(out), kept


def test_repeats_equal_all_windows(frame, odd, prose):
    # Rows of one doc_id with different texts share no window here: their order is by hash.
    rows = list(odd) + [(100, prose(50, 300)), (101, prose(51, 100) + " " + prose(50, 300) + " " + prose(52, 90))]
    rows += [(102, ("a b c " * 30).strip()), (103, prose(53, 19)), (104, prose(53, 19)), (105, prose(53, 20)),
             (106, prose(53, 20)), (107, prose(51, 100).replace(" ", "\n"))]
    found = dedup_digests(frame(rows))
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(map(tuple, found.collect())) == repeats(rows)[0]


def test_repeats_between_texts_of_one_id(spark, frame, prose):
    """Texts of one doc_id, and texts without, come in the order of their hashes."""
    passage = prose(55, 45)
    rows = [(i, f"{prose(560 + k, 30)} {passage} {prose(580 + k, 8 * k)}") for k, i in enumerate([7, 7, 7, None, None, None, 8, 8, 9])]
    rows += [(7, passage), (None, passage), rows[0], rows[4]]
    table = frame(rows)
    keys = {r.text: r.key for r in table.select("text", F.xxhash64("text").alias("key")).collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, keys[r[1]]))
    want = repeats([(order.index(r), r[1]) for r in rows])[0]
    want = Counter({(order[i][0], *rest): n for (i, *rest), n in want.items()})
    assert Counter(map(tuple, dedup_digests(table).collect())) == want


def test_windows_are_sent_without_the_hash_of_their_text(frame, prose):
    texts = identified(frame([(1, prose(59, 30))])).withColumns({"nth": F.lit(1).cast("long"), "places": F.array(F.lit(3))})
    edges = edge_rows(texts, 20)
    assert edges.columns == ["h1", "h2", "doc_id", "nth", "start", "length", "known"]
    assert [(r.doc_id, r.nth, r.start, r.length) for r in edges.collect()] == [(1, 1, s, 1) for s in range(4)]


def test_texts_without_repeats(frame, odd):
    rows = [r for r in odd if r[0] != 11]
    out = without_repeats(frame(rows))
    assert out.columns == frame(rows).columns
    got = Counter((r.doc_id, b" ".join((r.text or "").encode().split())) for r in out.collect())
    want = Counter((i, left) for i, left, had in repeats(rows)[1] if left or not had)
    assert got == want
    changed = [r for r in out.collect() if r.text]
    assert all(r.n_chars == len(r.text) for r in changed)


def test_every_window_has_an_anchor(prose):
    words = word_hashes(np.frombuffer(prose(70, 500).encode(), np.uint8))
    _, places = anchors(words, 20)
    covered = np.zeros(len(words), int)
    for start in range(len(words) - 19):
        covered[start] = ((places >= start) & (places <= start + 14)).sum()
    assert covered[: len(words) - 19].min() >= 1


def test_hashes_depend_on_words_only(prose):
    text = prose(71, 300)
    spaced = "  " + text.replace(" ", " \t\n ") + " "
    a, b = (word_hashes(np.frombuffer(t.encode(), np.uint8)) for t in (text, spaced))
    assert (a == b).all() and len(a) == len(text.split())
    distinct = len({tuple(text.encode().split()[i : i + 3]) for i in range(len(a) - 2)})
    assert len(np.unique(window_hashes(a, 3))) == distinct


def test_long_words_cross_slices():
    text = b"a" * 3_000_000 + b" b " + b"c" * 1_500_000
    assert len(word_hashes(np.frombuffer(text, np.uint8))) == 3


@pytest.mark.parametrize("size", [1024, 2048])
def test_long_words_are_told_apart(frame, prose, size):
    """Words with equal sums modulo 2^64 for every odd base: a Thue-Morse word and its mirror."""
    word = "a"
    while len(word) < size:
        word += word.translate({97: "b", 98: "a"})
    mirror = word.translate({97: "b", 98: "a"})
    before, after = prose(31, 12), prose(32, 13)
    rows = [(1, f"{before} {word} {after}"), (2, f"{before} {mirror} {after}"), (3, word), (4, mirror)]
    assert Counter(map(tuple, jaccard_groups(frame(rows)).collect())) == groups(rows, 4, 85)
    assert [r["n_removed"] for r in dedup_digests(frame(rows)).collect()] == [0] * 4
    hashes = [word_hashes(np.frombuffer(w.encode(), np.uint8))[0] for w in (word, mirror, word + "a")]
    assert len(set(hashes)) == 3
