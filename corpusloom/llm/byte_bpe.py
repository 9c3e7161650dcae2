"""Byte-level BPE encoding and decoding by ranked merges.

A chunk of documents is cut into words by the tokenizer's pattern, and only the words that the
chunk is the first of its partition to show go on to the merges. These are a fold in Spark
higher-order functions over an array of the word's pieces, each with the rank of the pair that it
begins, by a literal rank map: a step replaces the first pair of the least rank by the id of their
union and looks up the two new pairs, until no pair has a rank. (In a rank file the id of a piece
is its rank.) The ids of the words are then put together again document by document, in the same
task; no word is shuffled. Decoding concatenates the binary pieces of the ids.

A word starts as the ids of its bytes, but for what tables of the rank file's size settle beforehand
(:class:`Settled`): neighbouring ids that merge before anything could part them start as one, in
``ROUNDS`` rounds, and a word that is itself a piece starts as that, as it also does in the library. Of a
word of more than ``LONG_WORD`` bytes the fold would take time by the square of its length; such
words are merged by the same rule with a heap (:func:`merged_by_heap`), in n log n.

The rank map is a pair of literal arrays of fixed size, made from the rank file alone
(:func:`rank_table`); a Spark map literal would be searched from its start on every lookup.

Memory: a chunk holds about ``CHUNK_BYTES`` of text, or one document if that is longer, and passes
on as one row for each word and each document; the words known in a partition are forgotten after
``KNOWN_WORDS``, which changes only how often a word is merged again.

Defined results: a null text is empty and has no ids; ids decode to exactly the bytes of the
text; rows that repeat an id stay apart; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_rows

CHUNK_BYTES, KNOWN_WORDS, LONG_WORD, WORDS_STEP, STEP = 1 << 20, 300_000, 1_024, 8_192, 256
#: The mark at both ends of a word; no rank; where an element's rank begins, above its place (added when compared) and id.
END, NONE, PLACE, RANK, ROUNDS, GONE = 65_535, 1 << 33, 16, 27, 2, -1
#: Rows of a partition in order: the words that a chunk is first to show, then its documents as numbers of words.
WORD, DOCUMENT, FORGET = 0, 1, 2
CHUNK = "kind int, word array<bigint>, doc_id long, refs binary"


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Piece -> rank of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merges(table: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """Every pair of pieces whose union is a piece: (left, right, rank of the union)."""
    for piece, rank in table.items():
        for cut in range(1, len(piece)):
            left, right = table.get(piece[:cut]), table.get(piece[cut:])
            if left is not None and right is not None:
                yield left, right, rank


@lru_cache(maxsize=2)
def rank_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(shift, slots): the pair (left, right) stands at ``shift[left] + right`` as ``left << 16 | rank``.

    Rows, one for each left piece, are laid over each other so that no two pairs share a slot; a
    slot tells its left piece, and with its place its right one, so a lookup is exact.
    """
    rows: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for left, right, rank in merges(ranks(path)):
        rows[left].append((right, rank))
    shift, slots = np.zeros(1 << 16, np.int64), np.full(1 << 20, -1, np.int64)
    full = np.zeros(1 << 20, bool)
    begin: dict[int, int] = {}  # by length of a row: where the search for the next one of it begins
    singles = [left for left, own in rows.items() if len(own) == 1]
    for left, own in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        if len(own) == 1:
            continue
        right = np.array([r for r, _ in own])
        base, at = int(right.min()), max(int(right.min()), begin.get(len(own), 0))
        while True:
            free = np.flatnonzero(~full[at : at + 256]) + at
            fits = free[~full[free[:, None] + (right - base)].any(axis=1)] if len(free) else free
            if len(fits):
                break
            at += 256
        begin[len(own)] = int(fits[0])
        shift[left] = int(fits[0]) - base
        slots[right + shift[left]] = left << 16 | np.array([k for _, k in own])
        full[right + shift[left]] = True
    # Rows of one pair take what is free from the largest right piece on, so that no shift is negative.
    for left, at in zip(singles, np.flatnonzero(~full[1 << 16 :])[: len(singles)].tolist(), strict=True):
        (right, rank), = rows[left]
        shift[left] = at + (1 << 16) - right
        slots[at + (1 << 16)] = left << 16 | rank
    # Beyond the last used slot there must be room for every shift and right piece.
    return shift, slots[: int(shift.max()) + (1 << 16)]


def _literal(numbers: np.ndarray, kind: str) -> Column:
    """An array literal (folded by the optimizer from its decimal text)."""
    return F.split(F.lit(",".join(map(str, numbers.tolist()))), ",").cast(f"array<{kind}>")


def rank_map(path: str) -> tuple[Column, Column]:
    """The literal rank map: both arrays of :func:`rank_table`. A slot without a pair holds a number that no left piece matches."""
    shift, slots = rank_table(path)
    return _literal(shift, "int"), _literal(np.where(slots < 0, NONE, slots), "bigint")


def _lookup(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """The value of each key in a sorted table whose last key is beyond all; ``NONE`` where there is none."""
    at = np.searchsorted(table[0], wanted)
    return np.where(table[0][at] == wanted, table[1][at], NONE)


def _sorted_table(found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(sorted(found) + [1 << 40], np.int64)
    return keys, np.array([found.get(k, NONE) for k in keys.tolist()], np.int64)


class Settled:
    """What is known of a rank file beforehand, as tables of its size.

    ``pairs``: the rank of ``left << 16 | right``; ``of_bytes``: the same of two bytes, at ``first * 257 + second``
    (256 is the end mark). ``from_left``: at ``byte << 16 | id``, the least rank at which any piece that ends in the byte
    takes the id from the left; ``from_right``: at ``id << 9 | byte``, the least at which the id takes any
    piece that begins with the byte. A pair whose rank is below that of its left id from the left and that of its right id
    from the right therefore merges whatever becomes of its neighbours: nothing can part it before.
    """

    def __init__(self, path: str):
        pieces, table = list_of_pieces(path), ranks(path)
        pairs, left, right = {}, {}, {}
        for a, b, rank in merges(table):
            pairs[a << 16 | b] = rank
            at = pieces[a][-1] << 16 | b
            left[at] = min(left.get(at, NONE), rank)
            at = a << 9 | pieces[b][0]
            right[at] = min(right.get(at, NONE), rank)
        self.pairs, self.from_left, self.from_right = map(_sorted_table, (pairs, left, right))
        self.number = np.array([*(table[bytes([i])] for i in range(256)), END], np.int64)
        self.of_bytes = _lookup(self.pairs, (self.number[:, None] << 16 | self.number[None, :]).ravel())
        self.first, self.last = np.full(1 << 16, 256, np.int64), np.full(1 << 16, 256, np.int64)
        for rank, piece in enumerate(pieces):
            if piece:
                self.first[rank], self.last[rank] = piece[0], piece[-1]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids."""
        return _lookup(self.pairs, left << 16 | right)

    def joined(self, ids: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Where ``ids`` (END, a word, END, END, a word, ...) have pairs that merge whatever becomes of their neighbours."""
        least = rank < NONE
        least[1:] &= rank[1:] < rank[:-1]
        least[:-1] &= rank[:-1] < rank[1:]
        at = np.flatnonzero(least)
        sure = (_lookup(self.from_left, self.last[ids[at - 1]] << 16 | ids[at]) > rank[at]) & (_lookup(self.from_right, ids[at + 1] << 9 | self.first[ids[at + 2]]) > rank[at])
        out = np.zeros(len(ids), bool)
        out[at[sure]] = True
        return out


@lru_cache(maxsize=2)
def settled(path: str) -> Settled:
    return Settled(path)


def initial(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(elements, ends) of all words: each an END, the ids that it starts with, an END, with the rank of the pair that each begins."""
    table, known = ranks(path), settled(path)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = n.cumsum()
    starts = ends - n
    flat = np.full(int(n.sum()), 256, np.int64)
    inner = np.ones(len(flat), bool)
    inner[starts] = inner[ends - 1] = False
    flat[inner] = np.frombuffer(b"".join(words), np.uint8)
    ids, rank = known.number[flat], known.of_bytes[flat[:-1] * 257 + flat[1:]]
    for _ in range(ROUNDS):
        joined = known.joined(ids, rank)
        ids[joined] = rank[joined[:-1]]
        stays = np.append(True, ~joined[:-1])
        ids, ends, rank, joined = ids[stays], stays.cumsum()[ends - 1], np.append(rank, NONE)[stays][:-1], joined[stays]
        fresh = np.flatnonzero(joined[:-1] | joined[1:])  # all other pairs are as they were
        rank[fresh] = known.ranks(ids[fresh], ids[fresh + 1])
    for k, word in enumerate(words):  # whole pieces, and what the fold would take too long for
        if len(word) > LONG_WORD or word in table:
            at, end = (int(ends[k - 1]) if k else 0) + 1, int(ends[k]) - 1
            done = [table[word]] if word in table else merged_by_heap(word, path)
            ids[at : at + len(done)], ids[at + len(done) : end] = done, GONE
            rank[at - 1 : end] = NONE
    stays = ids != GONE
    return (np.append(rank, NONE) << RANK | ids)[stays], np.concatenate([[0], stays.cumsum()[ends - 1]])


def merged_by_heap(word: bytes, path: str) -> list[int]:
    """The ids of a word by the fold's rule, with a heap of its pairs by rank and place."""
    table = ranks(path)
    end, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))  # by start of a piece; an end of 0: merged away

    def push(at: int) -> None:
        if at >= 0 and end[at] < len(word) and (rank := table.get(word[at : end[end[at]]])) is not None:
            heapq.heappush(heap, (rank, at, end[end[at]]))

    heap: list[tuple[int, int, int]] = []
    for at in range(len(word) - 1):
        push(at)
    while heap:
        _, at, till = heapq.heappop(heap)
        middle = end[at]
        if not middle or middle >= len(word) or end[middle] != till:
            continue
        end[at], end[middle] = till, 0
        if till < len(word):
            before[till] = at
        push(before[at])
        push(at)
    out, at = [], 0
    while at < len(word):
        out.append(table[word[at : end[at]]])
        at = end[at]
    return out


def merged(word: Column, table: tuple[Column, Column]) -> Column:
    """The fold of a word's ranked merges over its elements, as :func:`initial` gives them.

    A step adds to each element its place, so that the least is the first pair of the least rank; if
    that rank is below 2^16, it replaces the pair's two elements by the union and looks up two new ranks.
    """
    shift, slots = table
    least_none = 1 << (RANK + 16)

    def rank_of(left: Column, right: Column) -> Column:
        return F.get(slots, (F.get(shift, left.cast("int")) + right).cast("int")).bitwiseXOR(F.shiftleft(left, 16))

    def replaced(x: Column, least: Column) -> Column:
        at = F.shiftright(least.bitwiseAND(F.lit((1 << RANK) - (1 << PLACE))), PLACE).cast("int")
        union = F.shiftright(least, RANK)
        left, right = F.get(x, at - 1).bitwiseAND(F.lit(END)), F.get(x, at + 2).bitwiseAND(F.lit(END))
        both = F.array(F.shiftleft(rank_of(left, union), RANK).bitwiseOR(left), F.shiftleft(rank_of(union, right), RANK).bitwiseOR(union))
        return F.concat(F.slice(x, F.lit(1), at - 1), both, F.slice(x, at + 3, F.size(x)))

    def step(x: Column) -> Column:
        least = F.array_min(F.transform(x, lambda e, i: e + F.shiftleft(i.cast("long"), PLACE)))
        return F.when(F.array_min(x) >= least_none, x).otherwise(F.get(F.transform(F.array(least), lambda e: replaced(x, e)), 0))

    # A word of n ids merges n - 1 times at most, and has n + 2 elements.
    times = F.when(F.array_min(word) >= least_none, F.lit(1)).otherwise(F.greatest(F.size(word) - 3, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), times), word, lambda x, _: step(x))


def _chunks(pattern: str, path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        known: defaultdict[str, int] = defaultdict(count().__next__)
        ids: list[int | None] = []
        refs: list[bytes] = []
        sent, size = 0, 0

        def rows(kind: int, words: pa.Array, doc_ids: list[int | None], numbers: list[bytes]) -> pa.RecordBatch:
            n = max(len(words), len(doc_ids), int(kind == FORGET))
            none = lambda a, t: a if len(a) else pa.nulls(n, t)
            columns = [pa.array(np.full(n, kind, np.int32)), none(words, pa.list_(pa.int64())), none(pa.array(doc_ids, pa.int64()), pa.int64()), none(pa.array(numbers, pa.binary()), pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "word", "doc_id", "refs"])

        def out() -> Iterator[pa.RecordBatch]:
            words = [w.encode("utf-8", "surrogatepass") for w in islice(known, sent, None)]
            for at in range(0, len(words), WORDS_STEP):
                elements, ends = initial(words[at : at + WORDS_STEP], path)
                yield rows(WORD, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(elements)), [], [])
            yield rows(DOCUMENT, [], ids, refs)

        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    words = find(text)
                    refs.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)).tobytes())
                    ids.append(doc_id)
                    size += len(text)
                    if size >= CHUNK_BYTES:
                        yield from out()
                        if len(known) > KNOWN_WORDS:
                            known = defaultdict(count().__next__)
                            yield rows(FORGET, [], [], [])
                        sent, size = len(known), 0
                        ids, refs = [], []
        if ids:
            yield from out()

    return run


def _assembled(finish: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = finish()
        flat, starts = [np.empty(0, np.uint16)], [np.zeros(1, np.int64)]
        for batch in batches:
            kinds = batch["kind"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at == end:
                    continue
                if kinds[at] == FORGET:
                    flat, starts = [np.empty(0, np.uint16)], [np.zeros(1, np.int64)]
                elif kinds[at] == WORD:
                    coded = batch["coded"].slice(at, end - at)
                    offsets = coded.offsets.to_numpy().astype(np.int64)
                    values = coded.values[offsets[0] : offsets[-1]].to_numpy(zero_copy_only=False)
                    n = np.diff(offsets) - 2  # without the marks at both ends
                    place = np.repeat(offsets[:-1] - offsets[0] + 1 - n.cumsum() + n, n) + np.arange(n.sum())
                    flat.append((values[place] & END).astype(np.uint16))
                    starts.append(starts[-1][-1] + n.cumsum())
                else:
                    flat, starts = [np.concatenate(flat)], [np.concatenate(starts)]
                    for k in range(at, end, STEP):
                        yield documents(batch.slice(k, min(STEP, end - k)), flat[0], starts[0], make)

    def documents(rows: pa.RecordBatch, flat: np.ndarray, starts: np.ndarray, make: Callable) -> pa.RecordBatch:
        numbers = rows["refs"].to_pylist()
        refs = np.frombuffer(b"".join(numbers), np.int32)
        n = starts[refs + 1] - starts[refs]
        ids = flat[np.repeat(starts[refs] - n.cumsum() + n, n) + np.arange(n.sum())]
        words = np.fromiter(map(len, numbers), np.int64, len(numbers)) // 4
        return make(rows["doc_id"], ids, np.concatenate([[0], n.cumsum()])[np.concatenate([[0], words.cumsum()])])

    return run


def _coded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    chunks = text_rows(docs, id_col, text_col).mapInArrow(_chunks(pattern, path), CHUNK)
    return chunks.select("kind", F.when(F.col("word").isNotNull(), merged(F.col("word"), rank_map(path))).alias("coded"), "doc_id", "refs")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every row."""

    def finish() -> Callable:
        def make(doc_ids: pa.Array, ids: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

        return make

    return _coded(docs, path, pattern, id_col, text_col).mapInArrow(_assembled(finish), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that its ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = list_of_pieces(path)
        for batch in batches:
            texts = [b"".join([pieces[i] for i in ids or ()]) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


@lru_cache(maxsize=2)
def list_of_pieces(path: str) -> list[bytes]:
    """The piece of each id."""
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for piece, rank in table.items():
        out[rank] = piece
    return out


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of every row, encoded and decoded again."""

    def finish() -> Callable:
        pieces = list_of_pieces(path)
        decimal = [str(i).encode() for i in range(len(pieces))]
        sha = hashlib.sha256

        def make(doc_ids: pa.Array, ids: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
            ids, cut = ids.tolist(), cut.tolist()
            coded, decoded = [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                own = ids[a:b]
                coded.append(sha(b",".join(map(decimal.__getitem__, own))).hexdigest())
                decoded.append(sha(b"".join(map(pieces.__getitem__, own))).hexdigest())
            n = np.diff(np.asarray(cut, np.int64))
            return pa.RecordBatch.from_arrays([doc_ids, pa.array(n), pa.array(coded), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return make

    return _coded(docs, path, pattern, id_col, text_col).mapInArrow(_assembled(finish), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
