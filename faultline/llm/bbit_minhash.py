"""b-bit MinHash near-duplicates: bands of minima find candidates, packed low bits judge them.

Method
------
1. A text is its set of word-shingle hashes; texts with equal sets are one *node*. Of each set,
   ``BANDS * ROWS`` hash functions give a least value.
2. Bands: the minima of ``ROWS`` functions together are a key, and nodes that share a key are
   candidates. Two sets of similarity 0.8 share none of the 72 keys with a probability of
   3 in 10^10; sets below 0.1 hardly ever share one. Candidates are tied to the least node of
   their key, the *hub*; pairs are not listed.
3. Signature: only the two low bits of each minimum are kept, packed into bit planes. Equal
   minima always agree and others in a quarter of all cases, so the share of agreeing
   places, counted by bits, is corrected to an estimate of the similarity. Pairs more than
   ``SIGMAS`` standard deviations below the threshold are left out.
4. Of each node's other pairs one is confirmed on the full sets by exact intersection, rather one
   that the estimate puts above the threshold. Confirmed links form components. Where candidates
   of a hub are then in several components, they are compared, by signature and then by full sets,
   in blocks of bounded size, so every link between components is found, also one that does not
   touch the hub. Pairs that are connected already are skipped: full sets travel about once
   for each node, however many copies a group has.

Cases
-----
Null, empty and blank texts: no shingles, no links, own doc_id, kept. Texts shorter than a
shingle: the whole text is the shingle. Very long texts: read whole, in slices. Ties and repeated
rows: equal texts are one node, and each row follows its own text. Null doc_id: such a row can
join a component but not name it, unless no row has a name (then null, kept). Empty table: no
rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.jaccard_join import lower_set, numbered, referred, short_node, tiles
from faultline.llm.tables import components, stored, thinned
from faultline.llm.words import as_long, byte_rows, digest, list_column, mix, numbers

ROWS, BANDS = 6, 72
#: Low bits kept of each minimum.
BITS = 2
#: How far below the threshold an estimate may lie; 6 lose one link in 10^9.
SIGMAS = 6.0
FUNCTIONS = ROWS * BANDS
SALTS = (numbers(FUNCTIONS, 31) >> np.uint64(32)).astype(np.uint32)
FACTORS = (numbers(FUNCTIONS, 32) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
PLANE = -(-FUNCTIONS // 64) * 8  # bytes
#: Cells of a table of functions by hashes, and members of a block of signatures.
CELLS, BLOCK, BLOCK_HASHES, BLOCK_SETS = 1 << 17, 2048, 1 << 20, 512


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of every function over a set, which is not empty."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(FUNCTIONS, np.iinfo(np.uint32).max, dtype=np.uint32)
    width = 1 << 13
    for begin in range(0, len(low), width):
        part = low[begin : begin + width]
        step = max(1, CELLS // len(part))
        for first in range(0, FUNCTIONS, step):
            some = slice(first, first + step)
            values = (part[None, :] ^ SALTS[some, None]) * FACTORS[some, None]
            np.minimum(best[some], values.min(axis=1), out=best[some])
    return best


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of minima."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    sums = (mix(rows + numbers(ROWS, 33)[None, :])).sum(axis=1, dtype=np.uint64)
    return mix(sums + numbers(BANDS, 34))


def signature(least: np.ndarray) -> bytes:
    """The low bits of all minima, one bit plane after the other.

    A minimum is spread over all bits first, each function's its own way.
    """
    spread = mix(least.astype(np.uint64) ^ numbers(FUNCTIONS, 35))
    planes = [np.packbits(((spread >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)) for b in range(BITS)]
    return b"".join(p.tobytes().ljust(PLANE, b"\0") for p in planes)


def signatures(column: pa.Array) -> np.ndarray:
    """Rows of packed signatures as a table of (row, plane, word)."""
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, dtype=np.uint64).reshape(len(column), BITS, PLANE // 8)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At how many places all kept bits are equal."""
    unlike = np.bitwise_or.reduce(a ^ b, axis=-2)
    return FUNCTIONS - np.bitwise_count(unlike).sum(axis=-1).astype(np.int64)


def similarity(places: np.ndarray) -> np.ndarray:
    """Estimated similarity: unequal minima agree by chance once in 2^BITS."""
    chance = 2.0**-BITS
    return (places / FUNCTIONS - chance) / (1 - chance)


def least_agreeing(percent: int, sigmas: float = SIGMAS) -> float:
    """Agreeing places of a pair at the threshold, less its spread."""
    share = percent / 100 + (1 - percent / 100) * 2.0**-BITS
    return FUNCTIONS * share - sigmas * (FUNCTIONS * share * (1 - share)) ** 0.5


def profiles(documents: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, ref, key, size and names of its set, band keys and signature.

    Rows that repeat a set of their batch have neither keys nor signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: set[bytes] = set()
            sizes, nodes, bands, bits = [], [], [], []
            for data in byte_rows(batch.column(3)):
                hashes = lower_set(data, width)
                node = digest(hashes) if len(hashes) else None
                first = node is not None and node not in known
                if first:
                    known.add(node)
                    least = minima(hashes)
                sizes.append(len(hashes))
                nodes.append(node)
                bands.append(band_keys(least) if first else hashes[:0])
                bits.append(signature(least) if first else None)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array([n and short_node(n) for n in nodes], pa.int64()),
                    list_column(bands),
                    pa.array(bits, pa.binary()),
                ],
                ["doc_id", "ref", "key", "n_shingles", "node", "short", "bands", "bits"],
            )

    return referred(documents).mapInArrow(
        run,
        "doc_id long, ref long, key long, n_shingles long, node binary, short long, bands array<long>, bits binary",
    )


def distinct_sets(rows: DataFrame) -> DataFrame:
    """One row for each set, with a row by which its text is found and its least doc_id.

    What follows from the set is equal in all its rows, so any of them may give it.
    """
    of_set = [("n_shingles", F.col("n_shingles")), ("short", F.col("short")), ("bits", F.col("bits"))]
    of_set.append(("bands", F.when(F.col("bits").isNotNull(), F.col("bands"))))
    return rows.filter("node is not null").groupBy("node").agg(
        *[F.first(value, ignorenulls=True).alias(name) for name, value in of_set],
        F.min(F.struct("ref", "key")).alias("at"),
        F.min("doc_id").alias("least"),
    )


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b), one for each node a: a hub b that by signature allows the similarity.

    Hubs whose estimate reaches the threshold go first, then the least hub.
    """
    enough, expected = least_agreeing(percent), least_agreeing(percent, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                places = agreeing(signatures(batch.column(3)), signatures(batch.column(4)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(places < expected)], ["a", "b", "hub", "unsure"]
                ).filter(pa.array(places >= enough))

    names = nodes.select("short", F.col("node").alias("a"), F.col("n_shingles").alias("n"), "bits")
    hubs = names.select(
        F.col("short").alias("hub"), F.col("a").alias("b"), F.col("n").alias("m"), F.col("bits").alias("hub_bits")
    )
    sizes = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    found = (
        pairs.join(names, "short").join(hubs, "hub").filter(sizes)
        .select("a", "b", "hub", "bits", "hub_bits")
        .mapInArrow(run, "a binary, b binary, hub long, unsure boolean")
    )
    best = F.min(F.struct("unsure", "hub", "b"))
    return found.groupBy("a").agg(best.alias("best")).select("a", "best.b")


def full_sets(documents: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Rows (node, hashes) of the sets ``wanted``, made again from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            found = {}
            for data in byte_rows(batch.column(0)):
                hashes = lower_set(data, width)
                node = digest(hashes)
                if node not in seen:  # repeated rows of one text lie together
                    seen.add(node)
                    found[node] = hashes
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), list_column(list(found.values()))], ["node", "hashes"]
            )

    at = nodes.join(wanted, "node").select("at.ref", "at.key").distinct()
    texts = thinned(referred(documents), at, "ref").join(at, ["ref", "key"])
    return texts.select("text").mapInArrow(run, "node binary, hashes array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    sizes = F.size("x") + F.size("y")
    shared = F.size(F.array_intersect("x", "y"))
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    near = 100 * shared >= percent * (sizes - shared)
    return pairs.join(left, "a").join(right, "b").filter(near).select("a", "b")


class Block:
    """Members of one block pair, by size; pairs in one component are not compared, nor pairs
    on one side if there are two."""

    def __init__(self, table: pa.Table, percent: int):
        order = np.argsort(table.column("n").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        self.table, self.percent, self.enough = table, percent, least_agreeing(percent)
        self.names = table.column("node").to_pylist()
        self.sizes = table.column("n").to_numpy()
        self.roots = numbered(table.column("root").to_pylist()).copy()
        self.sides = table.column("block").to_numpy()
        self.two = len(np.unique(self.sides)) > 1
        self.bits = signatures(table.column("bits").combine_chunks())

    def rivals(self, i: int) -> np.ndarray:
        end = int(np.searchsorted(self.sizes * self.percent, 100 * self.sizes[i], side="right"))
        rest = np.arange(i + 1, end)
        open_ = self.roots[rest] != self.roots[i]
        if self.two:
            open_ &= self.sides[rest] != self.sides[i]
        rest = rest[open_]
        return rest[agreeing(self.bits[rest], self.bits[i]) >= self.enough]

    def flagged(self) -> list[bytes]:
        hit = np.zeros(len(self.names), bool)
        for i in range(len(self.names)):
            found = self.rivals(i)
            hit[found] = True
            hit[i] |= len(found) > 0
        return [self.names[i] for i in np.flatnonzero(hit).tolist()]

    def links(self) -> list[tuple[bytes, bytes]]:
        lists = self.table.column("hashes").combine_chunks()
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        out = []
        for i in range(len(self.names)):
            mine = flat[ends[i] : ends[i + 1]]
            for j in self.rivals(i).tolist():
                if self.roots[i] == self.roots[j]:
                    continue
                shared = len(np.intersect1d(mine, flat[ends[j] : ends[j + 1]], assume_unique=True))
                if 100 * shared >= self.percent * (self.sizes[i] + self.sizes[j] - shared):
                    out.append((self.names[i], self.names[j]))
                    self.roots[self.roots == self.roots[j]] = self.roots[i]
        return out


def rival_members(members: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Rows (hub, node) of members that, by signature, may link to another component."""

    def run(table: pa.Table) -> pa.Table:
        found, hub = Block(table, percent).flagged(), table.column("hub")[0].as_py()
        return pa.table({"hub": pa.array([hub] * len(found), pa.int64()), "node": pa.array(found, pa.binary())})

    rows = tiles(members, BLOCK * 1024, BLOCK).join(bits, "node")
    return rows.groupBy("hub", "i", "j").applyInArrow(run, "hub long, node binary").distinct()


def block_links(members: DataFrame, bits: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components among members, confirmed on full sets."""

    def run(table: pa.Table) -> pa.Table:
        found = Block(table, percent).links()
        return pa.table({name: pa.array([pair[k] for pair in found], pa.binary()) for k, name in enumerate("ab")})

    rows = tiles(members, BLOCK_HASHES, BLOCK_SETS).join(bits, "node").join(sets, "node")
    return rows.groupBy("hub", "i", "j").applyInArrow(run, "a binary, b binary")


def minhash_groups(documents: DataFrame, width: int = 2, least_percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``documents``.

    The bands are made for similarities of 0.8 or more.
    """
    rows = stored(profiles(documents, width), "minhash")
    nodes = stored(distinct_sets(rows), "sets")
    banded = nodes.select("short", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("short").alias("hub"), F.max("short").alias("top"))
    hubs = hubs.filter("hub != top").select("band", "hub")
    members = stored(
        banded.join(hubs, "band").filter("short != hub").select("hub", "short").distinct(), "candidates"
    )
    near = stored(likely(members, nodes, least_percent), "likely")
    wanted = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = stored(full_sets(documents, nodes, wanted, width), "full")
    first = components(confirmed(near, sets, least_percent))

    names = nodes.select("short", "node", F.col("n_shingles").alias("n")).join(first, "node", "left")
    names = names.withColumn("root", F.coalesce("root", "node"))
    everyone = members.union(members.select("hub", F.col("hub").alias("short"))).distinct()
    placed = everyone.join(names, "short")
    open_hubs = placed.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    heads = names.select(F.col("short").alias("hub"), F.col("root").alias("hub_root"))
    heads = heads.groupBy("hub").agg(F.min("hub_root").alias("hub_root"))
    # Stored, so that the join below is of plain rows, whose hot hubs Spark can split.
    open_hubs = stored(open_hubs.filter("low != high").join(heads, "hub").select("hub", "hub_root"), "open-hubs")
    placed = stored(
        placed.join(open_hubs, "hub").select(
            "hub", "node", "n", "root", (F.col("root") == F.col("hub_root")).alias("linked")
        ),
        "open",
    )
    bits = nodes.select("node", "bits")
    rivals = stored(placed.join(rival_members(placed, bits, least_percent), ["hub", "node"], "left_semi"), "rivals")
    more = full_sets(documents, nodes, rivals.select("node").distinct(), width)
    second = stored(block_links(rivals, bits, stored(more, "full"), least_percent), "block-links")
    roots = first.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    second = second.join(roots, "a", "left").join(
        roots.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b", "left"
    )
    far = components(second.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    far = far.select(F.col("node").alias("root"), F.col("root").alias("top"))

    rooted = nodes.select("node", "least").join(first, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node")).join(far, "root", "left")
    rooted = rooted.select("node", "least", F.coalesce("top", "root").alias("root"))
    tops = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(tops, "root").select("node", "component_id")
    lean = rows.select("doc_id", "n_shingles", "node")
    grouped = lean.filter("node is not null").join(named, "node").select("doc_id", "n_shingles", "component_id")
    empty = lean.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: DuckDB form of the query op12_bbit_minhash: shared shingles of all pairs.
SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x20\\x09-\\x0D]+') as words from documents),
g as (
  select doc_id, unnest(list_distinct(case when len(words) = 0 then []
      else list_transform(range(1, greatest(len(words), 2)),
        lambda i: array_to_string(words[i:i + 1], ' ')) end)) as shingle from w),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from g a join g b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
c as (
  select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles,
    least(w.doc_id, coalesce((select min(r.b) from r where r.a = w.doc_id), w.doc_id)) as component_id
  from w left join n on n.doc_id = w.doc_id)
select doc_id, n_shingles, component_id, doc_id = component_id as kept from c
"""
