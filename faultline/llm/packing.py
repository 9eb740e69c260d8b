"""Lexical retrieval packing: windows of one size, filled with lexically near documents.

Method
------
A document is its token ids and an end id. Full windows of a long document stand alone; what
is left of it, and every shorter document, is an *item*. Terms are token ids. Document
frequencies and the mean length are counted over the items of all documents. Items are dealt
to tasks by range of their lexical key, the ``KEYS`` weightiest terms that another item holds
too, weightiest first, so that items of like content meet wherever they stood in the input;
a key of many items is split by hash. Tasks cut their rows, in the order of keys, into shards
of bounded size and build a BM25 inverted index of each shard's items with the corpus counts.
The longest unused item is the seed of a window: all its terms query the index, and its
unused neighbours fill the window, best first down the whole ranking: first those that fit
whole, then the best one is cut so that the window is full, and its rest stays an item. Only
where no unused item shares a term with the seed, the longest unused item serves. All windows but a shard's last are full. The
last one is cut into sequences whose lengths are powers of two, which need no padding.

An item is only compared with items of its shard; near items whose keys differ can lie in
different shards (README: recall). Items are stored once and sorted in each task, so a task
that is run again packs them alike. Ranges are cut by sampled keys.

Tokenizing
----------
The tokenizer drops white space and looks at nothing beyond it, so a text's ids are the ids
of its parts between ASCII white space. Where the tokenizer splits letters, single digits and
signs and lowers letters, a part of Latin-1 letters, ASCII digits and signs (no apostrophe, no
mark of a special token) is cut into these. Arrow finds the distinct pieces of many texts at once; a
task keeps the ids of those that it met last, about ``CACHE`` of them, and gives the tokenizer only
new ones. What a task knows goes with it: its Python worker waits for later steps, and an executor
pays for the memory of all its workers.

Cases
-----
Null and empty texts and texts of white space: the end id alone. Rows that repeat a doc_id are documents of
their own. Null doc_id: packed, the piece has no doc_id. Very long texts: cut over as many
sequences as they need. Empty tables: no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shipping import lean
from faultline.llm.tables import stored
from faultline.llm.words import LOWER, SPACE, byte_rows, slices

WINDOW, END = 2048, 1
SHARD_TOKENS, SHARD_DOCUMENTS = 1 << 21, 1 << 12
CACHE = 200_000
KEYS, KEY_BITS = 3, 21  # terms of a lexical key, and bits of each
K1, B = 1.2, 0.75
TOGETHER = 1 << 21  # bytes of texts whose pieces are looked up at once
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII signs but the apostrophe
LETTER, DIGIT, SIGN, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[65:91] = KINDS[97:123] = LETTER
KINDS[48:58] = DIGIT
KINDS[list(SIGNS)] = SIGN
LATIN = np.zeros(256, bool)  # second bytes of U+00C0 to U+00FF after byte C3, but not of the two signs there
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False
SMALL = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def word_ends(path: str) -> tuple[bool, np.ndarray]:
    """Whether letters, single digits and other signs are split apart, letters lowered and a
    word's last id tells so; which ids are such."""
    tool = tokenizer(path)
    settings = json.loads(tool.to_str())
    suffix = settings["model"].get("end_of_word_suffix")
    kinds = json.dumps(settings.get("pre_tokenizer"))
    splits = bool(suffix) and r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in kinds
    splits = splits and '"Lowercase"' in json.dumps(settings.get("normalizer"))
    last = np.zeros(tool.get_vocab_size() + 1, bool)
    if splits:
        last[[i for token, i in tool.get_vocab().items() if token.endswith(suffix)]] = True
    return splits, last


class Recent:
    """The values met last, between ``CACHE`` / 2 and ``CACHE`` of them."""

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def turn(self) -> None:
        if len(self.young) > CACHE // 2:
            self.old, self.young = self.young, {}

    def missing(self, keys) -> list[bytes]:
        """The keys without a value; the values of the others are young again."""
        young, old, out = self.young, self.old, []
        for key in [key for key in keys if key not in young]:
            if key in old:
                young[key] = old[key]
            else:
                out.append(key)
        return out


def letters(word: bytes) -> bool:
    """Whether a word is letters only, also as the tokenizer normalises it."""
    text = word.decode()
    return text.isalpha() and unicodedata.is_normalized("NFC", text) and text.lower().isalpha()


def cut(data: np.ndarray, splits: bool) -> tuple[pa.Array, np.ndarray]:
    """The pieces of texts that the tokenizer takes apart, and which bytes are no white space.

    With ``splits`` these are, in parts of Latin-1 letters, ASCII digits and signs, runs of
    letters (lowered) or signs and single digits; any other part is a piece as it is.
    """
    inside = ~SPACE[data]
    body = data[inside]
    begins = ~np.concatenate([[False], inside[:-1]])[inside]
    if splits and len(body):
        kinds, lower = KINDS[body], LOWER[body]
        lead = np.flatnonzero(body == 0xC3)
        lead = lead[LATIN[body[lead + 1]]]
        kinds[lead] = kinds[lead + 1] = LETTER
        lower[lead + 1] |= 0x20
        lower[lead[body[lead + 1] == 0x9F] + 1] = 0x9F  # sharp s is small
        kinds[:-1][(body[:-1] == ord("<")) & (body[1:] == ord("|"))] = OTHER
        other = kinds == OTHER
        if other.any():
            parts = np.flatnonzero(begins)
            other = np.repeat(np.logical_or.reduceat(other, parts), np.diff(parts, append=len(body)))
            kinds[other] = OTHER
            lower[other] = body[other]
        body = lower
        begins[1:] |= (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
    ends = np.append(np.flatnonzero(begins), len(body))
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))]
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, buffers), inside


class Ids:
    """Token ids of texts as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        self.tool, self.known = tokenizer(path), Recent()
        self.splits, self.last = word_ends(path)
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        # Small Latin-1 letters need no normalising and no pattern, those of ASCII no mapping of bytes either.
        self.small, self.ascii = Tokenizer(self.tool.model), Tokenizer(self.tool.model)
        self.ascii.pre_tokenizer = WhitespaceSplit()
        self.small.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])

    def encoded(self, texts: list[str], tool=None) -> list[np.ndarray]:
        found = (tool or self.tool).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4") for x in found]

    def learn_words(self, words: list[bytes], tool) -> None:
        """Ids of words of small letters: many are encoded as one text and cut at their ends."""
        for i in range(0, len(words), 1 << 12):
            some = words[i : i + (1 << 12)]
            ids = self.encoded([b" ".join(some).decode()], tool)[0]
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                each = [x.tobytes() for x in self.encoded([w.decode() for w in some])]
            else:
                whole, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                each = [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            self.known.young.update(zip(some, each, strict=True))

    def learn(self, pieces: list[bytes]) -> None:
        """Ids of new pieces. Many others are a word and signs after it, which are looked up apart."""
        plain, small, split, whole = [], [], [], []
        for piece in pieces:
            if self.splits and piece.isalpha():
                plain.append(piece)
                continue
            if self.splits and SMALL.fullmatch(piece):
                small.append(piece)
                continue
            word = piece.rstrip(SIGNS).lower()
            if self.splits and word and b"<|" not in piece and letters(word):
                split.append((piece, word, piece[len(word) :]))
            else:
                whole.append(piece)
        self.learn_words(plain, self.ascii)
        self.learn_words(small, self.small)
        self.learn_words(self.known.missing({word for _, word, _ in split}), self.tool)
        whole = list({*whole, *self.known.missing({sign for _, _, sign in split if sign})})
        young = self.known.young
        for i in range(0, len(whole), 1 << 13):
            some = whole[i : i + (1 << 13)]
            each = self.encoded([k.decode() for k in some])
            young.update(zip(some, (x.tobytes() for x in each), strict=True))
        for piece, word, sign in split:
            young[piece] = young[word] + young[sign] if sign else young[word]

    def of(self, texts: list[np.ndarray]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        some, owners, size = [], [], 0

        def flush() -> None:
            for i, ids in zip(owners, self.joined(some), strict=True):
                out[i].append(ids)

        for i, text in enumerate(texts):
            for begin, end in slices(text):
                some.append(text[begin:end])
                owners.append(i)
                size += end - begin
                if size >= TOGETHER:
                    flush()
                    some, owners, size = [], [], 0
        if some:
            flush()
        last = np.array([END], dtype="<u4").tobytes()
        return [b"".join(parts) + last for parts in out]

    def joined(self, texts: list[np.ndarray]) -> list[bytes]:
        """Ids of texts without their end ids. Each distinct piece is looked up once."""
        pieces, inside = cut(np.frombuffer(b" ".join([*texts, b""]), np.uint8), self.splits)
        if not len(pieces):
            return [b""] * len(texts)
        found = pieces.dictionary_encode()
        nth = found.indices.to_numpy()
        _, ends, body = found.dictionary.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(found.dictionary) + 1].tolist()
        body = body.to_pybytes()
        keys = [body[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.known.turn()
        self.learn(self.known.missing(keys))
        codes = list(map(self.known.young.__getitem__, keys))
        ids = np.frombuffer(b"".join(codes), "<u4")
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        first, count = np.cumsum(sizes) - sizes, sizes[nth]
        at = np.concatenate([[0], np.cumsum(count)])
        ids = ids[np.arange(at[-1]) + np.repeat(first[nth] - at[:-1], count)].tobytes()
        # A text's first piece follows as many bytes as the texts before it hold.
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
        held = np.add.reduceat(inside, starts[:-1], dtype=np.int64)
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)
        cuts = at[np.searchsorted(offsets, np.concatenate([[0], np.cumsum(held)]))]
        cuts = (4 * cuts).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Corpus(NamedTuple):
    """Counts over all items: items that hold each term, items, tokens."""

    held: np.ndarray
    items: int
    tokens: int

    def rarity(self, terms: np.ndarray) -> np.ndarray:
        holders = self.held[terms]
        return np.log1p((self.items - holders + 0.5) / (holders + 0.5))

    def norm(self, length):
        return K1 * (1 - B + B * length * self.items / self.tokens)


def item_terms(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, term and count of the distinct terms of each item, in order."""
    owner = np.repeat(np.arange(len(items), dtype=np.int64), [len(x) for x in items])
    # One sort for all items: an item's terms stand together, in order.
    pairs, count = np.unique(owner << 32 | np.concatenate(items).astype(np.int64), return_counts=True)
    return pairs >> 32, pairs & 0xFFFFFFFF, count


def counted(items: list[np.ndarray]) -> Corpus:
    terms = item_terms(items)[1]
    return Corpus(np.bincount(terms), len(items), sum(len(x) for x in items))


def lexical_keys(items: list[np.ndarray], corpus: Corpus) -> np.ndarray:
    """For each item its weightiest terms that another item holds too, as one number."""
    keys = np.zeros(len(items), np.int64)
    if not sum(len(x) for x in items):
        return keys
    item, term, count = item_terms(items)
    shared = corpus.held[term] > 1
    item, term, count = item[shared], term[shared], count[shared]
    length = np.array([len(x) for x in items], dtype=float)
    weight = corpus.rarity(term) * count * (K1 + 1) / (count + corpus.norm(length)[item])
    if not len(item):
        return keys
    first = np.flatnonzero(np.diff(item, prepend=-1))
    sizes, places = np.diff(first, append=len(item)), np.arange(len(item))
    for k in range(KEYS):
        best = np.repeat(np.maximum.reduceat(weight, first), sizes)
        # Of equal weights the first, which is the smallest term; what was taken weighs nothing.
        here = np.minimum.reduceat(np.where(weight == best, places, len(item)), first)
        here = here[weight[here] > 0]
        keys[item[here]] |= (term[here] + 1) << (KEY_BITS * (KEYS - 1 - k))
        weight[here] = 0
    return keys


class Index:
    """BM25 inverted index of one shard's items, with the counts of the corpus."""

    def __init__(self, items: list[np.ndarray], corpus: Corpus | None = None):
        corpus = corpus or counted(items)
        length = np.array([len(x) for x in items], dtype=float)
        item, term, count = item_terms(items)
        sizes = np.bincount(item, minlength=len(items))
        used, self.code = np.unique(term, return_inverse=True)
        holders = np.bincount(self.code, minlength=len(used))
        self.weight = corpus.rarity(term) * count * (K1 + 1) / (count + corpus.norm(length)[item])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(self.code, kind="stable")
        self.holder, self.impact = item[order], self.weight[order]
        self.start = np.concatenate([[0], np.cumsum(holders)])
        self.alive = np.arange(len(items))
        # Terms of more than an eighth of the items have a row of all items instead of a list.
        common = holders > len(items) // 8
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.dense = np.zeros((int(common.sum()), len(items)))
        often = common[self.code]
        self.dense[self.row[self.code[often]], item[often]] = self.weight[often]

    def keep(self, wanted: np.ndarray) -> None:
        """Leaves only the wanted of the items that can still be found."""
        at = np.cumsum(wanted) - 1
        self.alive, self.dense = self.alive[wanted], np.ascontiguousarray(self.dense[:, wanted])
        here = wanted[self.holder]
        self.start = np.concatenate([[0], np.cumsum(here)])[self.start]
        self.holder, self.impact = at[self.holder[here]], self.impact[here]

    def scores(self, seed: int, free: np.ndarray) -> np.ndarray:
        """For each item of ``alive`` its score, 0 if it is not free. Items that are not free may go for good."""
        free = free[self.alive]
        if 0 < 5 * np.count_nonzero(free) < 4 * len(free):
            self.keep(free)
            free = np.ones(len(self.alive), bool)
        codes = self.code[self.first[seed] : self.first[seed + 1]]
        rows = self.row[codes]
        out = np.zeros(len(free))
        for row in rows[rows >= 0].tolist():
            out += self.dense[row]
        rare = codes[rows < 0]
        begin, ends = self.start[rare], np.cumsum(self.start[rare + 1] - self.start[rare])
        if len(ends) and ends[-1]:
            count = np.diff(ends, prepend=0)
            at = np.arange(ends[-1]) + np.repeat(begin - ends + count, count)
            out += np.bincount(self.holder[at], weights=self.impact[at], minlength=len(free))
        out[~free] = 0
        return out

    def neighbours(self, seed: int, free: np.ndarray) -> np.ndarray:
        """All free items that share a term with the seed, best first."""
        scores = self.scores(seed, free)
        order = np.argsort(-scores, kind="stable")
        return self.alive[order[: np.count_nonzero(scores > 0)]]


def packed(
    documents: list[np.ndarray], whole: list[int] | None = None, corpus: Corpus | None = None
) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard's documents.

    With ``whole``, documents are given without their full windows, whose numbers it holds.
    """
    if whole is None:
        whole = [len(ids) // WINDOW for ids in documents]
        documents = [ids[n * WINDOW :] for ids, n in zip(documents, whole, strict=True)]
    out, sequence = [], 0
    for i, n in enumerate(whole):
        for k in range(n):
            out.append((i, k * WINDOW, WINDOW, sequence, 0))
            sequence += 1
    owner = [i for i, ids in enumerate(documents) if len(ids)]
    if not owner:
        return out
    begin = [whole[i] * WINDOW for i in owner]
    left = np.array([len(documents[i]) for i in owner])
    index = Index([documents[i] for i in owner], corpus)
    free = np.ones(len(owner), bool)
    by_size = iter(np.lexsort((np.arange(len(owner)), -left)).tolist())

    def next_free() -> int | None:
        return next((i for i in by_size if free[i]), None)

    window: list[tuple[int, int, int]] = []
    space, pending = WINDOW, []  # pending: rests of cut items, seeds of the next windows
    rest_of_all = int(left.sum())
    while rest_of_all:
        seed = pending.pop() if pending else next_free()
        free[seed] = False
        chosen = [seed]
        space = WINDOW - int(left[seed])
        if space > 0:
            scores = index.scores(seed, free)
            sizes = left[index.alive]
            # The best one that fits, again and again: what did not fit before does not fit later.
            while space:
                k = int(np.where(sizes <= space, scores, 0).argmax())
                if scores[k] <= 0 or sizes[k] > space:
                    break
                i = int(index.alive[k])
                chosen.append(i)
                free[i] = False
                scores[k] = 0
                space -= int(left[i])
            k = int(scores.argmax())
            near = [int(index.alive[k])] if space and scores[k] > 0 else []
            while space:
                i = near.pop() if near else next_free()
                if i is None:
                    break
                free[i] = False
                chosen.append(i)
                space -= min(space, int(left[i]))
        window, at = [], 0
        for i in chosen:
            length = min(int(left[i]), WINDOW - at)
            window.append((i, begin[i], length))
            begin[i] += length
            left[i] -= length
            at += length
            if left[i]:
                pending.append(i)
        rest_of_all -= at
        for i, start, length, number, offset in cut_last(window, at, sequence):
            out.append((owner[i], start, length, number, offset))
            sequence = number
        sequence += 1
    return out


def cut_last(window, filled: int, sequence: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces of a window; one that is not full is cut into powers of two, large ones first."""
    sizes = [WINDOW] if filled == WINDOW else [1 << k for k in range(11, -1, -1) if filled >> k & 1]
    space, offset = sizes.pop(0), 0
    for i, start, length in window:
        while length:
            if offset == space:
                space, offset, sequence = sizes.pop(0), 0, sequence + 1
            part = min(length, space - offset)
            yield i, start, part, sequence, offset
            start, length, offset = start + part, length - part, offset + part


def numbers_of(codes: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(c, dtype="<u4") for c in codes]


def coded(documents: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, tokens, crcs, rest, nth): crc32 of each full window, and the ids left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nth = Ids(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            codes = ids.of(byte_rows(batch.column(1)))
            ends = [len(c) // (4 * WINDOW) * (4 * WINDOW) for c in codes]
            crcs = [
                [zlib.crc32(c[a : a + 4 * WINDOW]) for a in range(0, end, 4 * WINDOW)]
                for c, end in zip(codes, ends, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(c) // 4 for c in codes], pa.int64()),
                    pa.array(crcs, pa.list_(pa.int64())),
                    pa.array([c[end:] for c, end in zip(codes, ends, strict=True)], pa.binary()),
                    pa.array(range(nth, nth + len(codes)), pa.int64()),
                ],
                ["doc_id", "tokens", "crcs", "rest", "nth"],
            )
            nth += len(codes)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lean(run), "doc_id long, tokens long, crcs array<long>, rest binary, nth long"
    )


def corpus_counts(items: DataFrame) -> Corpus:
    """Counts over all items; a task returns one row for each term it met and one of totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, tokens = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            rests = [x for x in numbers_of(batch.column(0).to_pylist()) if len(x)]
            if rests:
                found = counted(rests)
                if len(found.held) > len(held):
                    held = np.pad(held, (0, len(found.held) - len(held)))
                held[: len(found.held)] += found.held
                total, tokens = total + found.items, tokens + found.tokens
        terms = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([[-2, -1], terms]), pa.int64()),
                pa.array(np.concatenate([[total, tokens], held[terms]]), pa.int64()),
            ],
            ["term", "n"],
        )

    sums = items.select("rest").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    by_term = dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist(), strict=True))
    total, tokens = by_term.pop(-2, 0), by_term.pop(-1, 0)
    held = np.zeros(max(by_term, default=0) + 1, np.int64)
    held[list(by_term)] = list(by_term.values())
    return Corpus(held, total, tokens)


def dealt(items: DataFrame, corpus) -> DataFrame:
    """Items with their lexical keys, in ranges of keys and sorted in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = lexical_keys(numbers_of(batch.column(3).to_pylist()), corpus.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], [*batch.schema.names, "lexical"])

    schema = "doc_id long, tokens long, crcs array<long>, rest binary, nth long, lexical long"
    keyed = items.mapInArrow(run, schema).withColumn("spread", F.xxhash64("doc_id", "rest"))
    order = ["lexical", "spread", "nth"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order)


def pieces(documents: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    items = stored(coded(documents, path), "packing-items")
    corpus = documents.sparkSession.sparkContext.broadcast(corpus_counts(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, sequence = TaskContext.get().partitionId() << 36, 0
        held, some = 0, []

        def flush() -> pa.RecordBatch:
            nonlocal some, held, sequence
            whole = [len(crcs) for _, _, crcs, _ in some]
            rows = packed(numbers_of([rest for *_, rest in some]), whole, corpus.value)

            def crc(i: int, start: int, length: int) -> int:
                at = start - whole[i] * WINDOW
                _, _, crcs, rest = some[i]
                return crcs[start // WINDOW] if at < 0 else zlib.crc32(rest[4 * at : 4 * (at + length)])

            columns = [
                pa.array([some[i][0] for i, *_ in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([crc(*r[:3]) for r in rows], pa.int64()),
                pa.array([some[i][1] for i, *_ in rows], pa.int64()),
                pa.array([high + sequence + r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64()),
            ]
            sequence += max((r[3] for r in rows), default=-1) + 1
            some, held = [], 0
            return pa.RecordBatch.from_arrays(
                columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                some.append(row)
                held += len(row[3]) // 4
                if held >= SHARD_TOKENS or len(some) >= SHARD_DOCUMENTS:
                    yield flush()
        if some:
            yield flush()

    return dealt(items, corpus).select("doc_id", "tokens", "crcs", "rest").mapInArrow(
        lean(run),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
