"""N-gram Jaccard join: which documents share enough word runs, and the groups they form.

Method
------
1. Every text becomes a set of shingle hashes. Texts with equal sets are one *node*.
2. Sets are cut into *tiles* by size band. In a tile, two sets that reach the similarity
   differ in at most ``d`` hashes, so of more than ``d`` equal parts of the hash range at
   least one holds the same hashes in both (pigeonhole). A part's content is the key of a
   candidate group; no pair of equal enough sets is missed and a shared passage alone does
   not make a group. Nodes of a group are tied to its least node, the hub; pairs are not
   listed.
3. A hashed bitmap of each set, a 32nd of its size, bounds overlaps from above by a bit
   count. Each member is compared with its hub by bitmaps, and by exact intersection if that
   does not settle it; for that its text is read again, as only bitmaps are stored. Members
   outside the hub's component are compared with the others of the group in tiles of bounded
   size, again by bitmaps first; only sets that then may link to another component are made
   anew from their texts, sent whole and intersected as sorted arrays. Pairs that are connected
   already are skipped, so a tile returns at most one link per set.
4. Links form components; the name of a component is its least doc_id.

Cases
-----
Null and empty texts, and texts of spaces: no shingles, no links, own doc_id. Texts shorter
than a shingle: the whole text is the shingle. Rows that repeat a doc_id: each row follows
its own text. Null doc_id: such a row can join a component but not name it, unless no row
has a name (then null). Very long texts: read whole, in slices. Empty tables: no rows. Other
columns are not read by ``jaccard_groups``, whatever their names; ``one_of_each`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.tables import components, left_out, stored, stored_alone, surely_without, thinned
from faultline.llm.words import (
    LOWER, as_long, byte_rows, digest, list_column, mix, numbers, shingle_set,
)

#: Upper size of a tile over its lower size. Larger: fewer sets lie in two tiles, but each
#: needs more parts. 1.6 gives the fewest keys for similarities from 0.8 to 0.9.
BAND = 1.6
#: Hashes of all sets of a block together, and sets of a block at most and at least.
BLOCK_HASHES, BLOCK_MOST, BLOCK_LEAST = 1 << 20, 512, 8


def lower_set(data: np.ndarray, width: int) -> np.ndarray:
    return shingle_set(LOWER[data], width)


def bands(least_percent: int, largest: int) -> list[tuple[int, int]]:
    """Tiles as (last size, parts); sizes of tile i start after the last size of tile i-1.

    A set of size a and a larger one of size b that link differ in at most
    (a + b)(1 - t)/(1 + t) hashes and b is at most a/t, so in at most a(1 - t)/t.
    Some parts are spare, so that parts that are empty in both sets need not be compared.
    """
    out, last = [], 0
    while last < largest:
        last = max(last + 1, int((last + 1) * BAND))
        differ = last * (100 - least_percent) // least_percent
        out.append((last, differ + 1 + spare(differ)))
    return out


def spare(differ: int) -> int:
    """Parts that may be empty in a set; few sets have more empty ones."""
    return (3 + differ // 8) if differ else 0


def part_keys(hashes: np.ndarray, tile: int, last: int, least_percent: int) -> np.ndarray:
    """Keys of the parts of one set in one tile."""
    differ = last * (100 - least_percent) // least_percent
    extra = spare(differ)
    parts = differ + 1 + extra
    salt = numbers(1, 1000 + tile)[0]
    high = (hashes >> np.uint64(32)).astype(np.uint64)
    part = ((high * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    held = part[first]
    sums = np.add.reduceat(mix(hashes ^ salt), first)
    keys = mix(sums + (held.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + salt)
    if parts - len(held) > extra:  # rare: equal empty parts may be all that two sets share
        empty = np.setdiff1d(np.arange(parts), held).astype(np.uint64)
        keys = np.concatenate([keys, mix((empty + np.uint64(1)) * salt)])
    # Otherwise more than `extra` of the parts agree and at most `extra` of them are empty.
    return keys


def set_keys(hashes: np.ndarray, least_percent: int, tiles: list[tuple[int, int]]) -> np.ndarray:
    """Keys of a set: as the smaller set in its own tile, as the larger in the tile before."""
    size = len(hashes)
    own = next(i for i, (last, _) in enumerate(tiles) if size <= last)
    keys = [part_keys(hashes, own, tiles[own][0], least_percent)]
    if own and size * least_percent <= 100 * tiles[own - 1][0]:
        keys.append(part_keys(hashes, own - 1, tiles[own - 1][0], least_percent))
    return np.concatenate(keys)


def referred(documents: DataFrame) -> DataFrame:
    """Adds ``ref``, by which a text can be found again: the doc_id, or for null a hash.

    ``key`` is the hash of the text, which tells rows of one doc_id apart.
    """
    doc_id = F.col("doc_id").cast("long")
    return documents.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64("text")).alias("ref"),
        F.xxhash64("text").alias("key"), "text",
    )


def profiles(documents: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, ref, key, size of its set, and the set's 128-bit and 64-bit names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [lower_set(data, width) for data in byte_rows(batch.column(3))]
            nodes = [digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array([n and short_node(n) for n in nodes], pa.int64()),
                ],
                ["doc_id", "ref", "key", "n_shingles", "node", "short"],
            )

    return referred(documents).mapInArrow(
        run, "doc_id long, ref long, key long, n_shingles long, node binary, short long"
    )


def short_node(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


def candidate_keys(documents: DataFrame, width: int, least_percent: int) -> DataFrame:
    """Rows (key, short): candidate group keys of each text's set, with its 64-bit name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: list[tuple[int, int]] = []
        for batch in batches:
            keys, names = [], []
            for data in byte_rows(batch.column(0)):
                hashes = lower_set(data, width)
                if not len(hashes):
                    continue
                if not tiles or tiles[-1][0] < len(hashes):
                    tiles = bands(least_percent, len(hashes))
                found = set_keys(hashes, least_percent, tiles)
                keys.append(found)
                names.append(np.full(len(found), short_node(digest(hashes)), dtype=np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(np.concatenate(keys))), pa.array(np.concatenate(names))],
                    ["key", "short"],
                )

    return documents.select("text").mapInArrow(run, "key long, short long")


def candidate_sets(texts: DataFrame, width: int, whole: bool) -> DataFrame:
    """Rows (short, node, n, ref, bits) for texts, with ``whole`` also hashes; ``bits`` is the set's bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # repeated rows lie together after the join on ref
        for batch in batches:
            found, rows = {}, []
            for i, data in enumerate(byte_rows(batch.column(1))):
                hashes = lower_set(data, width)
                node = digest(hashes)
                if len(hashes) and node not in seen:
                    seen.add(node)
                    found[node] = hashes
                    rows.append(i)
            nodes, sets = list(found), list(found.values())
            columns = {
                "short": pa.array([short_node(n) for n in nodes], pa.int64()),
                "node": pa.array(nodes, pa.binary()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "ref": batch.column(0).take(pa.array(rows, pa.int64())),
                "bits": pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
            }
            if whole:
                columns["hashes"] = list_column(sets)
            yield pa.RecordBatch.from_pydict(columns)

    schema = "short long, node binary, n long, ref long, bits binary" + ", hashes array<long>" * whole
    return texts.select("ref", "text").mapInArrow(run, schema)


def texts_of(documents: DataFrame, refs: DataFrame) -> DataFrame:
    """The texts with one of the distinct ``refs``."""
    # An inner join: Spark would move a semi join below the filter, to all texts.
    return thinned(referred(documents), refs, "ref").join(refs, "ref")


def whole_sets(documents: DataFrame, sets: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Rows (node, n, hashes, bits) that hold all of ``nodes``; their texts are read again."""
    refs = sets.select("node", "ref").join(nodes.select("node").distinct(), "node").select("ref").distinct()
    return candidate_sets(texts_of(documents, refs), width, True).select("node", "n", "hashes", "bits")


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap of at least two bits a hash: a bit is set if an odd number falls on it.

    Bits of two sets differ at most as often as their hashes do.
    """
    size = max(64, 1 << int(2 * len(hashes) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap with fewer bits: halves are added, as the places of hashes would be."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_link(unlike, a, b, percent: int):
    """Whether sets of sizes a and b can link if at least ``unlike`` of their hashes differ."""
    most = (a + b - unlike) // 2
    return 100 * most >= percent * (a + b - most)


class Group:
    """Sets of one tile in order of size. ``roots`` are numbers of known components; pairs
    in one component, or on one side of a tile of two blocks, are not compared."""

    def __init__(self, names, sizes, roots, sides, bits, percent: int):
        self.order = np.lexsort((np.arange(len(names)), sizes))
        self.names = [names[i] for i in self.order]
        self.sizes = np.asarray(sizes)[self.order]
        self.root = np.asarray(roots)[self.order].copy()
        self.side = np.asarray(sides)[self.order]
        self.two = len(set(sides)) > 1
        words = min(len(b) for b in bits)
        self.maps = np.stack([folded(bits[i], words) for i in self.order])
        self.percent = percent

    def rivals(self, i: int) -> np.ndarray:
        """Larger sets that may link to set i and are not in its component."""
        end = int(np.searchsorted(self.sizes * self.percent, 100 * self.sizes[i], side="right"))
        rest = np.arange(i + 1, end)
        keep = self.root[rest] != self.root[i]
        if self.two:
            keep &= self.side[rest] != self.side[i]
        rest = rest[keep]
        unlike = np.bitwise_count(self.maps[rest] ^ self.maps[i]).sum(axis=1).astype(np.int64)
        return rest[may_link(unlike, self.sizes[rest], self.sizes[i], self.percent)]

    def flagged(self) -> list:
        hit = np.zeros(len(self.names), bool)
        for i in range(len(self.names)):
            found = self.rivals(i)
            hit[found] = True
            hit[i] |= len(found) > 0
        return [self.names[i] for i in np.flatnonzero(hit).tolist()]

    def links(self, sets: list[np.ndarray]) -> list[tuple]:
        sets, out = [sets[i] for i in self.order], []
        for i in range(len(sets)):
            for j in self.rivals(i).tolist():
                if self.root[j] != self.root[i] and self.linked(sets[i], sets[j]):
                    out.append((self.names[i], self.names[j]))
                    self.root[self.root == self.root[j]] = self.root[i]
        return out

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * shared >= self.percent * (len(a) + len(b) - shared)


def bit_rows(column: pa.Array) -> list[np.ndarray]:
    return [np.ascontiguousarray(x).view(np.uint64) for x in byte_rows(column)]


def hub_links(documents: DataFrame, members: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (node, hub_node) between members of candidate groups and their hubs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hubs = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            unlike = []
            for x, y in zip(bit_rows(batch.column(3)), bit_rows(batch.column(5)), strict=True):
                words = min(len(x), len(y))
                unlike.append(int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()))
            keep = may_link(np.array(unlike, np.int64), sizes, hubs, percent)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], ["node", "hub_node"]
            ).filter(pa.array(keep))

    bits = sets.select("short", "node", "n", "bits")
    hub_bits = bits.select(
        F.col("short").alias("hub"), F.col("node").alias("hub_node"), F.col("n").alias("hub_n"),
        F.col("bits").alias("hub_bits"),
    )
    close = stored(
        members.join(bits, "short").join(hub_bits, "hub")
        .select("node", "hub_node", "n", "bits", "hub_n", "hub_bits")
        .mapInArrow(run, "node binary, hub_node binary")
        .distinct(),
        "close",
    )
    nodes = close.select("node").union(close.select("hub_node"))
    full = stored(whole_sets(documents, sets, nodes, width).select("node", "n", "hashes"), "close-sets")
    hubs = close.select(F.col("hub_node").alias("node"))
    hub_full = thinned(full, hubs, "node").select(
        F.col("node").alias("hub_node"), F.col("n").alias("hub_n"), F.col("hashes").alias("hub_hashes")
    )
    full = thinned(full, close, "node")
    shared = F.size(F.array_intersect("hashes", "hub_hashes"))
    near = 100 * shared >= percent * (F.col("n") + F.col("hub_n") - shared)
    return close.join(full, "node").join(hub_full, "hub_node").filter(near).select("node", "hub_node")


def tiles(members: DataFrame, hashes_at_most: int, most: int) -> DataFrame:
    """Rows (hub, node, n, root, linked, block, i, j): members of groups dealt to block pairs.

    A group is cut into blocks by hash. Blocks of members that are not in the hub's component
    meet all blocks of the group; the others do not meet each other.
    """
    spread = members.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(64)))
    partial = spread.groupBy("hub", "_salt").agg(
        F.sum(F.when(F.col("linked"), 0).otherwise(1)).alias("u"),
        F.sum(F.when(F.col("linked"), 1).otherwise(0)).alias("l"),
        F.max("n").alias("n"),
    )
    groups = partial.groupBy("hub").agg(F.sum("u").alias("u"), F.sum("l").alias("l"), F.max("n").alias("n"))
    size = F.greatest(F.lit(BLOCK_LEAST), F.least(F.lit(most), F.floor(F.lit(hashes_at_most) / F.col("n"))))
    groups = groups.filter("u > 0 and u + l > 1").select(
        "hub",
        F.ceil(F.col("u") / size).cast("int").alias("open"),
        F.ceil(F.col("l") / size).cast("int").alias("shut"),
    )
    place = F.xxhash64("node", F.lit(5))
    block = F.when(~F.col("linked"), F.pmod(place, F.col("open"))).otherwise(
        F.col("open") + F.pmod(place, F.greatest("shut", F.lit(1)))
    )
    others = F.when(F.col("linked"), F.sequence(F.lit(0), F.col("open") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("open") + F.col("shut") - 1)
    )
    placed = members.join(groups, "hub").withColumn("block", block.cast("int"))
    dealt = placed.withColumn("other", F.explode(others))
    return dealt.select(
        "hub", "node", "n", "root", "block",
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
    )


def numbered(roots: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(r, len(known)) for r in roots])


def flagged_members(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (hub, node) of members that, by their bitmaps, may link to another component."""
    rows = tiles(members, BLOCK_HASHES * 32, 4 * BLOCK_MOST).join(sets.select("node", "bits"), "node")

    def run(table: pa.Table) -> pa.Table:
        group = Group(
            table.column("node").to_pylist(), table.column("n").to_pylist(),
            numbered(table.column("root").to_pylist()), table.column("block").to_pylist(),
            bit_rows(table.column("bits")), percent,
        )
        found = group.flagged()
        hub = table.column("hub")[0].as_py()
        return pa.table({"hub": pa.array([hub] * len(found), pa.int64()), "node": pa.array(found, pa.binary())})

    return rows.groupBy("hub", "i", "j").applyInArrow(run, "hub long, node binary").distinct()


def block_links(members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of candidate groups, decided by the whole sets."""
    rows = tiles(members, BLOCK_HASHES, BLOCK_MOST).join(full.select("node", "hashes", "bits"), "node")

    def run(table: pa.Table) -> pa.Table:
        lists = table.column("hashes").combine_chunks()
        flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).view(np.uint64)
        ends = lists.offsets.to_numpy()
        group = Group(
            table.column("node").to_pylist(), table.column("n").to_pylist(),
            numbered(table.column("root").to_pylist()), table.column("block").to_pylist(),
            bit_rows(table.column("bits")), percent,
        )
        found = group.links([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        return pa.table(
            {"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())}
        )

    return rows.groupBy("hub", "i", "j").applyInArrow(run, "a binary, b binary")


def linked_roots(documents: DataFrame, named: DataFrame, width: int, least_percent: int) -> DataFrame:
    """Rows (node, root) of the nodes that have a link, one root for each component."""
    hub = F.min("short").over(Window.partitionBy("key"))
    members = stored(
        candidate_keys(documents, width, least_percent)
        .withColumn("hub", hub)
        .filter("short != hub")
        .select("hub", "short")
        .distinct(),
        "members",
    )
    shorts = members.select("short").union(members.select("hub")).distinct()
    refs = named.join(shorts, "short").groupBy("node").agg(F.min("ref").alias("ref")).select("ref").distinct()
    sets = stored(candidate_sets(texts_of(documents, refs), width, False), "sets")

    first = hub_links(documents, members, sets, width, least_percent)
    near = components(first.select(F.col("node").alias("a"), F.col("hub_node").alias("b")))
    everyone = members.union(members.select("hub", F.col("hub").alias("short"))).distinct()
    names = sets.select("short", "node", "n").join(near, "node", "left")
    names = stored(names.withColumn("root", F.coalesce("root", "node")), "names")
    hubs = names.groupBy(F.col("short").alias("hub")).agg(F.min("root").alias("hub_root"))
    placed = everyone.join(names, "short").join(hubs, "hub").select(
        "hub", "node", "n", "root", (F.col("root") == F.col("hub_root")).alias("linked")
    )
    flagged = flagged_members(placed, sets, least_percent)
    rivals = stored(placed.join(flagged, ["hub", "node"], "left_semi"), "rivals")
    second = block_links(rivals, whole_sets(documents, sets, rivals, width), least_percent)
    second = stored(second, "block-links")
    more = second.join(near.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
    more = more.join(near.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    more = more.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    far = components(more)
    tops = far.select(F.col("node").alias("root"), F.col("root").alias("top"))
    rooted = near.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return rooted.unionByName(left_out(far, near.select("node"), ["node"]))


def grouped_rows(documents: DataFrame, width: int, least_percent: int) -> DataFrame:
    """Per row: doc_id, ref, key, n_shingles, and doc_id and key of its component's first row."""
    rows = stored(profiles(documents, width), "profiles")
    named = rows.filter("node is not null")
    roots = stored_alone(
        documents.sparkSession, lambda: linked_roots(documents, named, width, least_percent), "roots"
    )

    # A component's first row: by doc_id, null last, then by text.
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key"))
    nodes = named.groupBy("node").agg(first_row.alias("least"))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = rooted.groupBy("root").agg(F.min("least").alias("least"))
    names = rooted.select("node", "root").join(tops, "root").select("node", "least")
    found = named.join(names, "node")
    empty = rows.filter("node is null")
    return found.select(
        "doc_id", "ref", "key", "n_shingles", F.col("least.doc_id").alias("component_id"),
        F.col("least.key").alias("first_key"),
    ).union(
        empty.select("doc_id", "ref", "key", "n_shingles", F.col("doc_id").alias("component_id"), "key")
    )


def jaccard_groups(documents: DataFrame, width: int = 4, least_percent: int = 85) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``documents``."""
    return grouped_rows(documents, width, least_percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(documents: DataFrame, width: int = 5, least_percent: int = 80) -> DataFrame:
    """One row of each group: the one that names it; texts without words stay.

    Rows are told apart by doc_id and text. Of a group's rows with the naming doc_id, and of
    groups without doc_id, the row whose text has the least hash stays; of rows that repeat
    it, one.
    """
    groups = grouped_rows(documents, width, least_percent).filter("n_shingles > 0")
    groups = stored(
        groups.select(
            F.col("ref").alias("_ref"), F.col("key").alias("_key"),
            (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("first_key"))).alias("first"),
        ),
        "groups",
    )
    names = ["_ref", "_key"]
    gone = groups.filter("not first").select(*names).distinct()
    twice = groups.filter("first").groupBy(*names).count()
    twice = stored(twice.filter("count > 1").select(*names), "twice")
    packed = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"),
        F.xxhash64("text").alias("_key"),
    ).withColumn("_ref", F.coalesce(F.col("_row.doc_id").cast("long"), "_key"))
    doubtful = left_out(thinned(packed, gone, "_ref"), gone, names)
    kept = surely_without(packed, gone, "_ref").unionByName(doubtful)
    if not twice.isEmpty():
        again = thinned(kept, twice, "_ref").join(twice, names)
        again = again.groupBy(*names).agg(F.first("_row").alias("_row"))
        once = left_out(thinned(kept, twice, "_ref"), twice, names)
        kept = surely_without(kept, twice, "_ref").unionByName(once).unionByName(again.select(*kept.columns))
    return kept.select("_row.*")


#: DuckDB form of the query op4_jaccard_join.
SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x20\\x09-\\x0D]+') as words from documents),
g as (
  select doc_id, unnest(list_distinct(case when len(words) = 0 then []
      else list_transform(range(1, greatest(len(words) - 2, 2)),
        lambda i: array_to_string(words[i:i + 3], ' ')) end)) as shingle from w),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from g a join g b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * shared >= 85 * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles,
  least(w.doc_id, coalesce((select min(r.b) from r where r.a = w.doc_id), w.doc_id)) as component_id
from w left join n on n.doc_id = w.doc_id
"""
