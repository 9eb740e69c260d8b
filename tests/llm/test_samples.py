"""Shards, mixture and the pipeline."""

import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from faultline.llm import mixing, queries, sharding

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


@pytest.fixture(scope="module")
def sources(odd, prose):
    rows = [(i, t, "big" if i is None or i % 3 else "é") for i, t in odd]
    rows += [(1000 + i, prose(i, 5 + i % 50), "big" if i % 3 else f"s{i % 7}") for i in range(400)]
    return rows + [(2000, "a b", None), (2001, None, None), (2002, "", "blank"), (2003, "w " * 40, "")]


def check_shards(rows, found, shards):
    sizes = Counter(r.shard for r in found)
    assert set(sizes) == set(range(min(shards, len(rows)))) or len(rows) == 0
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    assert Counter((r.doc_id, r.source, r.size, r.text_crc32) for r in found) == Counter(
        (i, s, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, s in rows
    )


def test_shards_match_the_mixture(frame, sources):
    found = sharding.interleaved(frame(sources)).collect()
    check_shards(sources, found, 16)
    total = Counter(r.source for r in found)
    for shard in range(16):
        here = [r for r in found if r.shard == shard]
        for source, n in Counter(r.source for r in here).items():
            assert abs(n - total[source] * len(here) / len(found)) < len(total) + 1
    again = sharding.interleaved(frame(list(reversed(sources)))).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


def test_shards_equal_a_plain_sort(frame, prose):
    rows = [(i, prose(i, 9), f"s{i % 3}" if i % 4 else "s0") for i in range(120)]
    found = {r.doc_id: r for r in sharding.interleaved(frame(rows), shards=7).collect()}
    seeded = {r.doc_id: r.code for r in frame(rows).selectExpr(
        "doc_id", f"xxhash64({sharding.SEED}, doc_id, crc32(encode(text, 'UTF-8')), cast(octet_length(text) + 1 as bigint)) as code"
    ).collect()}
    unsigned = {i: c % (1 << 64) for i, c in seeded.items()}
    place = {}
    for source in {s for _, _, s in rows}:
        own = sorted((i for i, _, s in rows if s == source), key=lambda i: (unsigned[i] >> 52, seeded[i]))
        place |= {i: ((2 * r + 1) / (2 * len(own)), "s" + source, seeded[i]) for r, i in enumerate(own)}
    for nth, i in enumerate(sorted(place, key=place.get)):
        shard = nth * 7 // 120
        start = -(-shard * 120 // 7)
        assert (found[i].shard, found[i].slot) == (shard, nth - start)


def test_shards_of_few_rows(frame):
    assert sharding.interleaved(frame([])).count() == 0
    assert [(r.shard, r.slot) for r in sharding.interleaved(frame([(None, None, None)])).collect()] == [(0, 0)]


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        share = {s: 3 * sizes[s] if s in capped else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in capped and share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return share
        capped |= over


def test_mix_meets_targets(frame, sources):
    found = mixing.copies(frame(sources)).collect()
    sizes = Counter()
    for _, text, source in sources:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken, largest = plain_targets(sizes), Counter(), Counter()
    assert len(found) == len(sources)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source] + 1
    again = mixing.copies(frame(list(reversed(sources)))).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


def test_mix_repeats_documents(frame, sources):
    out = mixing.mixed(frame(sources))
    assert out.columns == frame(sources).columns
    drawn = Counter()
    for r in mixing.copies(frame(sources)).collect():
        drawn[r.doc_id, r.source, r.size] += r.copies
    got = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in out.collect())
    assert got == +drawn


def test_mix_of_nothing(frame):
    assert mixing.copies(frame([])).count() == 0
    assert mixing.mixed(frame([])).count() == 0
    assert [(r.target, r.copies) for r in mixing.copies(frame([(1, None, None)])).collect()] == [(0.0, 0)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    from checks.compare import open_database, rows_by_name

    folder = "/root/testdata/sf0.001"
    table = queries.QUERIES[name](spark, folder)
    cursor = open_database(folder).execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(table.columns)
    assert rows_by_name(table.columns, table.collect()) == rows_by_name(names, cursor.fetchall())


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "retrieval_packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.toArrow())
        seen[name] = docs.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality_rules"]}
    assert not [i for i in kept if labels.get(i) == 0]
    near = [r.doc_id for r in seen["jaccard_join"]]
    assert len(near) == len(set(near)) < len(kept) and set(near) < kept
    windows = Counter()
    for r in seen["substring_dedup"]:
        words = r.text.encode().split()
        windows.update({b" ".join(words[i : i + 20]) for i in range(len(words) - 19)})
    assert not [w for w, n in windows.items() if n > 2]
    mix = Counter(r.doc_id for r in seen["source_mix"])
    assert set(mix) <= {r.doc_id for r in seen["substring_dedup"]} and max(mix.values()) <= 3
    packed = Counter()
    for r in seen["retrieval_packing"]:
        packed[r.doc_id] += r.length
    tokens = {r.doc_id: r.doc_tokens for r in seen["retrieval_packing"]}
    assert {i: n for i, n in packed.items()} == {i: mix[i] * tokens[i] for i in mix}


def test_pipeline_runs(spark):
    run = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert run.columns[0] == "doc_id" and run.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_rows_without_doc_id_are_spread(frame, prose):
    """A third of all rows and more without doc_id stand in many places of the order."""
    rows = [(None, prose(1000 + k, 20)) for k in range(400)] + [(k, prose(k, 20)) for k in range(200)]
    placed = mixing.sized(frame(rows)).filter("doc_id is null").groupBy("part").count().collect()
    assert len(placed) > 100 and max(r["count"] for r in placed) < 20
    found = mixing.copies(frame(rows))
    again = mixing.copies(frame(list(reversed(rows))))
    key = lambda r: (r.text_hash, r.copies)
    assert sorted(found.collect(), key=key) == sorted(again.collect(), key=key)
    assert found.count() == 600
