"""Fingerprints, classifiers, rules, licences and packing against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from faultline.llm import (
    calibration, compression_quality, fingerprints, licenses, packing, quality_rules, toxicity,
)

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def raw(text):
    return np.frombuffer(text.encode(), np.uint8)


# Fingerprints


def test_fingerprints_and_neighbours(frame, odd):
    found = fingerprints.with_neighbours(frame(odd)).collect()
    rows = sorted(((i, t or "") for i, t in odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = Counter()
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        a, b, c = (fingerprints.fingerprint(raw(t)) for t in (text, changed, following))
        want[
            doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.as_text(a),
            fingerprints.as_text(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c),
        ] += 1
    assert Counter(map(tuple, found)) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_fingerprint_of_one_row_and_none(frame):
    row = fingerprints.with_neighbours(frame([(7, "a b c d e f g h")])).first()
    assert row.near_next == 1.0 and row.n_chars == 15
    assert fingerprints.with_neighbours(frame([])).count() == 0


def test_sketch_keeps_all_hashes_below_the_bound(prose):
    text = prose(31, 4000)
    from faultline.llm.words import shingle_set

    every = shingle_set(raw(text.lower()), 5)
    assert (fingerprints.fingerprint(raw(text)) == every[every < fingerprints.BOUND]).all()


def test_sketches_merge_and_estimate_containment(prose):
    small, large = prose(32, 2000), prose(33, 30_000)
    a, whole = fingerprints.fingerprint(raw(small)), fingerprints.fingerprint(raw(small + " " + large))
    assert fingerprints.likeness(a, whole) == 1.0
    both = fingerprints.merged(a, fingerprints.fingerprint(raw(large)))
    assert len(np.setdiff1d(both, whole)) == 0 and len(whole) - len(both) <= 4
    half = " ".join(small.split()[:1000])
    other = fingerprints.fingerprint(raw(half + " " + prose(34, 1000)))
    assert abs(fingerprints.likeness(a, other) - 0.5) < 0.12


# Quality rules


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {
        i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)
    }
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


def test_rules_equal_loops(frame, label_frame, odd):
    rows = [*odd, (20, "# a|b\n" * 40), (21, "same line here\nsame line here\n\n \n other " + "w " * 3)]
    labels = label_frame([(i, 1, 0) for i in range(1, 12)] + [(None, 1, 0), (3, None, 0)])
    found = quality_rules.judged(frame(rows), labels).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == Counter((i, *base_counts(t)) for i, t in rows)
    assert all(not r.kept for r in found if r.base_failed)
    keys = Counter((r.doc_id, r.kept) for r in found)
    kept = quality_rules.keepers(frame(rows), labels)
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n for (i, k), n in keys.items() if k})
    assert kept.columns == frame(rows).columns
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # texts are judged where they lie


def test_ratio_equals_its_definition(frame, label_frame, prose):
    rows = [(i, prose(300 + i, 60)) for i in range(20)] + [(i, "%% ## " * 10 + prose(300 + i, 60)) for i in range(20, 40)]
    labels = label_frame([(i, int(i < 20), 0) for i in range(40)])
    good = {i for i in range(20) if zlib.crc32(str(i).encode()) % 5}
    raw_counts, trusted = Counter(), Counter()
    for i, text in rows:
        grams = Counter(quality_rules.ngram_buckets(raw(text)).tolist())
        raw_counts += grams
        if i in good:
            trusted += grams
    size, total, target = quality_rules.BUCKETS, sum(raw_counts.values()), sum(trusted.values())

    def weight(bucket):
        base = (raw_counts[bucket] + 1) / (total + size)
        return np.log((trusted[bucket] + size * base) / (target + size)) - np.log(base)

    found = {r.doc_id: r.llr for r in quality_rules.judged(frame(rows), labels).collect()}
    for i, text in rows:
        want = np.mean([weight(b) for b in quality_rules.ngram_buckets(raw(text)).tolist()])
        assert found[i] == pytest.approx(want, abs=1e-9)
    assert min(found[i] for i in range(20)) > max(found[i] for i in range(20, 40))


def test_every_trusted_document_counts(spark, label_frame):
    """However many are trusted: the ratio of each text is that of counts over all of them."""
    rows = [(i, f"t{i % 4001} u{i % 89}" if i % 26 else f"r{i}") for i in range(26_100)]
    table = spark.createDataFrame([*rows, (5, "t5 again"), (None, "t5 lost")], "doc_id long, text string")
    labels = label_frame([(i, int(i % 26 > 0), 0) for i, _ in rows] + [(5, 0, 0), (90_000, 1, 0)])
    good = {i for i, _ in rows if i % 26 and zlib.crc32(str(i).encode()) % 5}
    assert len(good) > 20_000
    size = quality_rules.BUCKETS
    base, target = np.zeros(size), np.zeros(size)
    for i, text in [*rows, (5, "t5 again"), (None, "t5 lost")]:
        for bucket in quality_rules.ngram_buckets(raw(text)).tolist():
            base[bucket] += 1
            target[bucket] += i in good
    base = (base + 1) / (base.sum() + size)
    want = np.log((target + size * base) / (target.sum() + size)) - np.log(base)
    assert np.allclose(quality_rules.weights(table, labels), want, rtol=0, atol=1e-9)


def test_rules_without_labels(frame, label_frame, prose):
    found = quality_rules.judged(frame([(1, " ".join(str(i) for i in range(90))), (2, "x")]), label_frame([])).collect()
    assert {r.doc_id: (r.llr, r.kept) for r in found} == {1: (0.0, True), 2: (0.0, False)}
    assert quality_rules.judged(frame([]), label_frame([])).count() == 0


# Classifiers


def accuracy(scores, labels, bound):
    return np.mean([(scores[i] >= bound) == bool(y) for i, y in labels.items()])


@pytest.fixture(scope="module")
def shown(prose):
    """300 documents; odd ones are junk, every third insults."""
    rng = random.Random(5)
    rows, quality, toxic = [], {}, {}
    for i in range(300):
        words = prose(500 + i, 80).split(" ")
        quality[i], toxic[i] = int(i % 2 == 0), int(i % 3 == 0)
        if toxic[i]:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["scoundrel", "vermin", "rascally"])
        if not quality[i]:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        rows.append((i, " ".join(words)))
    return rows, quality, toxic


def test_classifiers_on_held_out_rows(frame, label_frame, shown):
    rows, quality, toxic = shown
    labels = label_frame([(i, quality[i], toxic[i]) for i in quality])
    held = {i for i in quality if zlib.crc32(str(i).encode()) % 5 == 0}
    for module, known, bound in ((compression_quality, quality, 0.3), (toxicity, toxic, 0.5)):
        found = module.scores(frame(rows), labels).collect()
        assert {r.doc_id for r in found if r.held_out} == held
        scores = {r.doc_id: r.score for r in found}
        assert accuracy(scores, {i: known[i] for i in held}, bound) >= 0.95
        # Labels of held-out rows are not used.
        flipped = label_frame([(i, quality[i] ^ (i in held), toxic[i] ^ (i in held)) for i in quality])
        again = {r.doc_id: r.score for r in module.scores(frame(rows), flipped).collect()}
        assert again == pytest.approx(scores, abs=1e-12)


def test_classifiers_take_odd_rows(frame, label_frame, odd, shown):
    rows, quality, toxic = shown
    labels = label_frame([(i, quality[i], toxic[i]) for i in quality] + [(None, 1, 1), (5, None, None)])
    moved = [(None if i is None else i + 1000, t) for i, t in odd]
    for module in (compression_quality, toxicity):
        found = module.scores(frame([*rows, *moved]), labels).collect()
        assert len(found) == len(rows) + len(odd)
        assert all(r.score is not None and 0 <= r.score <= 1 and r.held_out is not None for r in found)
        empty = {round(r.score, 9) for r in found if r.doc_id in (1003, 1004)}
        assert len(empty) == 1


@pytest.mark.parametrize("module", [compression_quality, toxicity])
def test_classifiers_without_two_classes(frame, label_frame, prose, module):
    rows = [(i, prose(i, 30)) for i in range(8)]
    for labels in ([], [(i, 1, 1) for i in range(8)]):
        scores = {r.score for r in module.scores(frame(rows), label_frame(labels)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1
    assert module.scores(frame([]), label_frame([])).count() == 0


def all_segments(scores):
    """Maximal scoring segments by their recursive definition: the best segment (the shortest
    of equal ones, the first of those), then the same left and right of it."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a + 1, len(scores) + 1):
            total += scores[b - 1]
            if total > 0 and (best is None or (total, -(b - a)) > (best[0], -(best[2] - best[1]))):
                best = (total, a, b)
    if best is None:
        return []
    _, a, b = best
    right = [(s, x + b, y + b) for s, x, y in all_segments(scores[b:])]
    return [*all_segments(scores[:a]), best, *right]


def test_segments_equal_their_definition():
    rng = np.random.default_rng(8)
    for _ in range(300):
        scores = rng.integers(-6, 6, rng.integers(0, 25)).astype(float) + rng.integers(0, 64, 1) / 4096
        got = [(round(s, 6), a, b) for s, a, b in toxicity.segments(scores)]
        assert [x[1:] for x in got] == [x[1:] for x in all_segments(scores.tolist())]


def test_clean_law_solves_its_equation():
    rng = np.random.default_rng(9)
    clean = [rng.normal(-0.6, 1.0, 200) for _ in range(50)]
    rate, k = toxicity.clean_law(clean)
    assert np.mean(np.exp(rate * np.concatenate(clean))) == pytest.approx(1, abs=1e-6)
    best = [max(s for s, _, _ in toxicity.segments(x)) for x in clean]
    assert sum(k * 200 * np.exp(-rate * s) for s in best) == pytest.approx(50)


def test_passage_is_found(frame, label_frame, shown):
    rows, quality, toxic = shown
    labels = label_frame([(i, quality[i], toxic[i]) for i in quality])
    insult = "scoundrel vermin rascally vermin scoundrel vermin"
    text = "theé " * 40 + insult + " theé" * 40
    row = toxicity.scores(frame([*rows, (2000, text)]), labels).filter("doc_id = 2000").first()
    assert row.n_passages == 1
    data, passage = text.encode(), row.passages[0]
    assert data[passage.start : passage.last + len("vermin")].decode() == insult


def test_logistic_fit_is_a_minimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -2.0] + 0.3)))).astype(int)
    model = calibration.fit_logistic(x, y, y.mean(), ridge=1e-6)
    p = 1 / (1 + np.exp(-((x - model["mean"]) / model["scale"] @ model["weights"] + model["bias"])))
    assert np.abs(x.T @ (p - y)).max() < 1e-3 and abs((p - y).sum()) < 1e-3


# Licences


def test_license_rules(frame):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\n"
        "The above copyright notice and this permission notice shall be included in all copies.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    )
    rows = [
        (1, mit), (2, "Some text. Released under the MIT Licence. More text."), (3, None), (4, ""), (5, "  \n "),
        (6, "// All rights reserved.\n" * 2), (7, "Copyright (c) 2020 Somebody.\nAll rights reserved."),
        (8, "Licensed under CC BY-NC 4.0.\nwords\n" + "Licensed under the Apache License, Version 2.0."),
        (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
        (10, "All rights reserved\n" + "x\n" * 9 + "Copyright 1999 me"), (None, "Released under the MIT License."),
        (2, "license of nobody"),
    ]
    got = Counter((r.doc_id, r.n_license_sentences, r.licenses, r.n_unknown) for r in licenses.scan(frame(rows)).collect())
    assert got == Counter(
        [
            (1, 3, "MIT", 0), (2, 1, "MIT", 0), (3, 0, "", 0), (4, 0, "", 0), (5, 0, "", 0),
            (6, 2, "All-Rights-Reserved", 0), (7, 2, "All-Rights-Reserved", 0), (8, 2, "Apache-2.0,CC-BY-NC-4.0", 0),
            (9, 1, "", 1), (10, 2, "All-Rights-Reserved", 1), (None, 1, "MIT", 0), (2, 0, "", 0),
        ]
    )
    assert licenses.scan(frame([])).count() == 0


def test_wrapped_licenses(frame):
    mit = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse products."""
    apache = """Licensed under the Apache License,
Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy
of the License at"""
    rows = [
        (1, mit), (2, "\n".join(" * " + x for x in mit.split("\n"))), (3, mit.replace("\n", "\r\n")), (4, bsd),
        (5, "\n".join("# " + x for x in bsd.split("\n"))), (6, apache), (7, "\n".join("// " + x for x in apache.split("\n"))),
        (8, "All  rights\treserved"), (9, "All rights\n\nreserved"), (10, "see all rights\nreserved"),
        (11, "Released under the\nMIT License. Words."),
    ]
    got = {r.doc_id: (r.n_license_sentences, r.licenses) for r in licenses.scan(frame(rows)).collect()}
    assert got == {
        1: (4, "MIT"), 2: (4, "MIT"), 3: (4, "MIT"), 4: (2, "BSD-3-Clause"), 5: (2, "BSD-3-Clause"),
        6: (2, "Apache-2.0"), 7: (2, "Apache-2.0"), 8: (1, "All-Rights-Reserved"), 9: (0, ""), 10: (0, ""),
        11: (1, "MIT"),
    }


# Packing


def check_packing(rows, found):
    tool = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in rows:
        ids = np.array(tool.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        want[doc_id, len(ids) // 4, ids] += 1
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    starts = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found)
    assert sum(n * k[2] for k, n in starts.items()) == sum(n * k[1] for k, n in want.items())
    for (doc_id, size, ids), n in want.items():
        here = sorted(k for k in starts if k[0] == doc_id and k[4] == size
                      and k[3] == zlib.crc32(ids[4 * k[1] : 4 * (k[1] + k[2])]))
        covered = np.zeros(size + 1, int)
        for k in here:
            covered[k[1]] += starts[k]
            covered[k[1] + k[2]] -= starts[k]
        assert (np.cumsum(covered)[:-1] >= n).all()


def test_packing_is_an_exact_cover(frame, odd, prose):
    rows = [*odd, *[(200 + i, prose(800 + i, 20 + 37 * i)) for i in range(60)], (300, "<|endoftext|> a<|startoftext|>b")]
    found = packing.pieces(frame(rows), PATH).collect()
    check_packing(rows, found)


def test_ids_equal_the_tokenizer():
    rng = random.Random(11)
    pieces = ["a", "Don't", "we'LL", "x,", "(y)", "\"z\"", "…", "é", "É,", "E\u0301", "H\u0331", "12.5", "½", "漢字。", "<|", "|>",
              "<|endoftext|>", "<|ENDOFTEXT|>", "'", "'s", "-", "###", "\u00a0", "\u3000", "İ", "ß", "K", "_", "\x1c", "ǰ", "I\u0307",
              "\U0001f600", "\u200d", "Ⅷ", "ﬁ", " ", "\n", "\t", "  ", "."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    tool = Tokenizer.from_file(PATH)
    found = packing.Ids(PATH).of([raw(t) for t in texts])
    for text, ids in zip(texts, found, strict=True):
        want = tool.encode(text, add_special_tokens=False).ids + [1]
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)


def test_tokenizer_sees_each_run_once(monkeypatch):
    """Runs of letters and signs and digits go to the tokenizer once, however parts combine them."""
    given, encoded = [], packing.Ids.encoded

    def counting(self, texts, *tool):
        given.extend(texts)
        return encoded(self, texts, *tool)

    monkeypatch.setattr(packing.Ids, "encoded", counting)
    texts = [f"{w}{i},été{i % 10}" for i in range(500) for w in ("ab", "AB", "Éa")] + ["don't <|x|> 12½", "ÿ×Þ÷ß E\u0301"]
    tool, ids = Tokenizer.from_file(PATH), packing.Ids(PATH)
    found = ids.of([raw(t) for t in texts]) + ids.of([raw(t) for t in reversed(texts)])
    for text, got in zip([*texts, *reversed(texts)], found, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids + [1], repr(text)
    assert sum(len(t.split()) for t in given) < 30


def test_python_workers_keep_no_ids_after_packing(frame, prose):
    """Workers wait for later steps; what they know of a packing's texts would add up there."""
    rows = frame([(i, prose(i, 300)) for i in range(40)]).repartition(4)
    assert packing.coded(rows, PATH).filter("tokens > 1").count() == 40

    def held(batches):
        import gc

        for batch in batches:
            n = sum(type(x).__name__ == "Ids" for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(batch), pa.int64())], ["n"])

    assert {r.n for r in rows.select("doc_id").mapInArrow(held, "n long").collect()} == {0}


def test_packing_of_nothing(frame):
    assert packing.pieces(frame([]), PATH).count() == 0
    row = packing.pieces(frame([(1, None)]), PATH).collect()
    assert [tuple(r)[:3] for r in row] == [(1, 0, 1)]


def test_index_scores_equal_bm25():
    rng = np.random.default_rng(2)
    items = [rng.integers(0, 50, rng.integers(5, 30)).astype("<u4") for _ in range(40)]
    index = packing.Index(items)
    free = np.ones(40, bool)
    free[[0, 5, 9]] = False
    mean, k1, b = np.mean([len(x) for x in items]), packing.K1, packing.B
    for seed in (0, 5):
        scores = np.zeros(40)
        for term in set(items[seed].tolist()):
            held = [i for i in range(40) if term in items[i]]
            rarity = np.log1p((40 - len(held) + 0.5) / (len(held) + 0.5))
            for i in held:
                n = (items[i] == term).sum()
                scores[i] += rarity * n * (k1 + 1) / (n + k1 * (1 - b + b * len(items[i]) / mean))
        got = index.neighbours(seed, free)
        want = sorted((i for i in range(40) if free[i] and scores[i] > 0), key=lambda i: -scores[i])
        assert np.allclose(scores[got], scores[want])


def test_used_index_finds_as_a_new_one():
    """Items that were taken leave the index; what it finds among the others does not change."""
    rng = np.random.default_rng(8)
    items = [rng.integers(0, 300, rng.integers(1, 60)).astype("<u4") for _ in range(90)]
    index, free = packing.Index(items), np.ones(90, bool)
    for seed in rng.permutation(90).tolist():
        free[seed] = False
        assert index.neighbours(seed, free).tolist() == packing.Index(items).neighbours(seed, free).tolist()
    assert len(index.alive) < 20


def test_neighbours_fill_windows():
    """Documents of one topic share windows although topics alternate in the input."""
    rng = np.random.default_rng(6)
    documents = [rng.integers(1000 * (i % 4) + 10, 1000 * (i % 4) + 200, 512).astype("<u4") for i in range(64)]
    together = defaultdict(set)
    for i, _, _, sequence, _ in packing.packed(documents):
        together[sequence].add(i % 4)
    assert all(len(topics) == 1 for topics in together.values())


def test_window_takes_all_its_neighbours():
    """Short documents of one topic fill a window, however many it needs, before others do."""
    rng = np.random.default_rng(7)
    topic = [rng.integers(10, 200, 16).astype("<u4") for _ in range(127)]
    documents = [np.arange(10, 26, dtype="<u4"), *topic]
    documents += [rng.integers(5000, 5200, 16).astype("<u4") for _ in range(128)]
    index = packing.Index(documents)
    free = np.ones(256, bool)
    free[0] = False
    near = [i for i in range(1, 256) if set(documents[i].tolist()) & set(range(10, 26))]
    assert len(near) > 64 and sorted(index.neighbours(0, free)) == near
    windows = defaultdict(set)
    for i, _, _, sequence, _ in packing.packed(documents):
        windows[sequence].add(i)
    assert len(windows[0] & {0, *near}) == len(near) + 1


def test_seed_asks_with_all_its_terms():
    seed = np.arange(10, 60, dtype="<u4")
    documents = [seed, *[np.full(3, i, "<u4") for i in range(10, 60)], np.full(3, 999, "<u4")]
    free = np.ones(len(documents), bool)
    free[0] = False
    assert sorted(packing.Index(documents).neighbours(0, free)) == list(range(1, 51))


def test_counts_and_neighbours_cover_the_corpus(spark, frame):
    """Counts are those of all rows, and one topic's documents meet although they lie apart."""
    rng = random.Random(5)
    topics = [[f"{a}{b}" for a in "bdfgk" for b in ends] for ends in (("ar", "ul"), ("ish", "oon"), ("ent", "ock"), ("ame", "ife"))]
    rows = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(300))) for i in range(96)]
    table = frame(rows).repartition(8, "doc_id")
    tool = Tokenizer.from_file(PATH)
    codes = [np.array(tool.encode(t, add_special_tokens=False).ids + [1]) for _, t in rows]
    found = packing.corpus_counts(packing.coded(table, PATH))
    assert (found.items, found.tokens) == (96, sum(map(len, codes)))
    held = Counter(x for c in codes for x in set(c.tolist()))
    assert {t: n for t, n in enumerate(found.held.tolist()) if n} == held
    together = defaultdict(Counter)
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for r in packing.pieces(table, PATH).collect():
            together[r.sequence_id][r.doc_id % 4] += r.length
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    own = sum(max(c.values()) for c in together.values())
    assert own > 0.85 * found.tokens
    before = Counter(r.partition for r in table.selectExpr("spark_partition_id() partition").collect())
    assert len(before) > 1


def test_license_scan_of_a_very_long_text(frame, odd):
    """100,000 known sentences after one that opens a rule, and rows of all odd kinds."""
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."
    long = grant + "\nAll rights reserved." * 100_000
    rows = [(1, long), (2, grant + "\nLicensed under CC0 1.0" * 3000)]
    found = {r.doc_id: r for r in licenses.scan(frame(rows)).collect()}
    assert found[1].n_license_sentences == 100_001 and found[1].n_unknown == 1
    assert found[1].licenses == "All-Rights-Reserved" and found[2].licenses == "CC0-1.0"
    assert found[2].sequence == "mit-grant" + " cc0" * 3000
    scanned = licenses.scan(frame(odd)).collect()
    assert Counter(r.doc_id for r in scanned) == Counter(i for i, _ in odd)
    assert all(r.licenses == "" and r.n_license_sentences == 0 for r in scanned)
