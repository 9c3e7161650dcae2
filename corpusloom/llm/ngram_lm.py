"""N-gram language-model scores from Elias-Fano tries.

Tokens are words, A-Z in lower case, split at ASCII white space, and one end token for each
document. Words are told by 64-bit hashes.

Counts are gathered by scatter and gather over blocks, twice. A chunk of documents (a few MB) lists its
distinct words, sorted, with how often each stands in its training documents, and sends them to
shards by hash; a shard adds up the counts of all chunks and answers every block in the order in
which it asked. Then the chunks do the same with their distinct (context, word) pairs, which go to
shards by a hash of the context, so that a shard sees all successors of its contexts. Contexts
that stand more often than one shard's share over ``HOT`` are dealt by a hash of the pair instead; their
counts are sent along, and there are fewer than ``HOT`` of them for each shard. A chunk sends nothing
to a shard that it has no key for, so there are never more blocks than keys. Each chunk then scores its
documents from the answers. The chunks are kept in the shared folder between the passes, as local
word numbers, compressed; all sizes grow with the input and nothing but the totals N and V and the
hot contexts reaches the driver.

Words are exact by 64 bits. In a pair the context keeps 36 bits of its hash and the word 28: pairs
stay apart but for a chance of 2^-64 for each two, and two contexts share their successors' space
with a chance of 2^-36.

A shard's trie (:class:`Trie`) has two levels. The first is the Elias-Fano sequence of its
context hashes, with a monotone sequence of pointers into the second; the second is the Elias-Fano
sequence of the successors, each relative to its context: (rank of the context, word hash). A lookup
finds the context by successor search, reads its two pointers, and searches between them for the word.
Beside each successor stands its smoothed probability, quantised to 16 bits on a logarithmic scale. The
levels lie in one file, for as long as the shard's task runs, and are memory-mapped when they are queried.

The score interpolates with the add-one unigram distribution p by a Dirichlet prior,
``p(w | c) = count(c, w) / (count(c) + MU) + MU / (count(c) + MU) p(w)``. The first part, the
probability that is left to a seen successor after smoothing, is what the trie stores; the weight of the second
part follows from the count of the context. The context of the first word is the end token. Over
the words of the training documents and one unknown word these probabilities sum to one, but for
quantising.

Defined results: a null or empty text is its end token alone; rows that repeat an id are scored
and counted each; without training documents N is 0 and every base score is 0 (one unknown word,
of probability 1); an empty table gives an empty result.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, text_rows, written

CHUNK_CHARS, SHARD_CHARS, MU, CONTEXT_BITS, WORD_BITS, HOT = 6 << 20, 24_000_000, 4.0, 36, 28, 8
SPACES, UPPER, LOWER = r"[\x20\x09-\x0D]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END_WORD = "\n"  # no word contains white space
_ONE = np.uint64(1)
_STEPS = 1 << 10  # of a quantised probability, for each factor of 2


# --- bits ---------------------------------------------------------------------------------


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers: low bits packed, high bits in unary.

    ``find`` is a successor search: the zeros of the unary part give where the numbers of one high
    part begin; among those, which may be many, the low bits are searched by halves.
    """

    SAMPLE = 8  # one position for every so many 64-bit words of the unary part

    def __init__(self, low_bits: int, n: int, high: np.ndarray, low: np.ndarray, zeros: np.ndarray):
        self.low_bits, self.n, self.high, self.low, self.zeros = low_bits, n, high, low, zeros

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        high_part = (values >> np.uint64(low_bits)).astype(np.int64)
        size = int(universe >> low_bits) + n + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[high_part + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        low = np.zeros(-(-n * low_bits // 64) + 2, np.uint64)
        if low_bits:
            own = values & ((_ONE << np.uint64(low_bits)) - _ONE)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, own << shift)
            over = shift + np.uint64(low_bits) > 64
            np.bitwise_or.at(low, word[over] + 1, own[over] >> (np.uint64(64) - shift[over]))
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])[:: cls.SAMPLE].astype(np.uint64)
        return cls(low_bits, n, high, low, zeros)

    def lows(self, at: np.ndarray) -> np.ndarray:
        """The low bits of the numbers at these places."""
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | upper) & ((_ONE << np.uint64(self.low_bits)) - _ONE)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place in the unary part of the k-th zero (or one), from 0."""
        sums = self.zeros.astype(np.int64)
        sums = np.arange(len(sums)) * (64 * self.SAMPLE) - sums if ones else sums
        block = np.searchsorted(sums, k, side="right") - 1
        word, left = block * self.SAMPLE, k - sums[block]
        bits_of = lambda at: self.high[np.minimum(at, len(self.high) - 1)] if ones else ~self.high[np.minimum(at, len(self.high) - 1)]
        for _ in range(self.SAMPLE):
            own = np.bitwise_count(bits_of(word)).astype(np.int64)
            on = left >= own
            word, left = np.where(on, word + 1, word), np.where(on, left - own, left)
        bits, place = bits_of(word), np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            half = bits & ((_ONE << np.uint64(width)) - _ONE)
            own = np.bitwise_count(half).astype(np.int64)
            on = left >= own
            left, place = np.where(on, left - own, left), np.where(on, place + width, place)
            bits = np.where(on, bits >> np.uint64(width), half)
        return word * 64 + place

    def get(self, at: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        return ((self._select(at, True) - at).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(at)

    def _begins(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a smaller high part."""
        return np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - high + 1, 0)

    def find(self, values: np.ndarray, low_end: np.ndarray | None = None, high_end: np.ndarray | None = None) -> np.ndarray:
        """The place of each value, between two places if they are given; -1 where the sequence has no such number."""
        if not self.n:
            return np.full(len(values), -1, np.int64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & ((_ONE << np.uint64(self.low_bits)) - _ONE)
        at, end = self._begins(high), self._begins(high + 1)
        if low_end is not None:
            at, end = np.maximum(at, low_end), np.minimum(end, high_end)
        found = np.flatnonzero(at < end)
        at, end, low = at[found], end[found] - 1, low[found]
        todo = np.flatnonzero(at < end)
        while len(todo):  # halve what is left of each, until one place is
            middle = (at[todo] + end[todo]) >> 1
            less = self.lows(middle) < low[todo]
            at[todo[less]], end[todo[~less]] = middle[less] + 1, middle[~less]
            todo = todo[at[todo] < end[todo]]
        out = np.full(len(values), -1, np.int64)
        hit = self.lows(at) == low
        out[found[hit]] = at[hit]
        return out

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.low_bits, self.n], np.uint64), self.high, self.low, self.zeros]

    @classmethod
    def from_parts(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])


def quantised(probability: np.ndarray) -> np.ndarray:
    """-log2 of a probability in steps of 1/_STEPS. 16 bits."""
    return np.round(-np.log2(probability) * _STEPS).clip(0, 65_535).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return np.exp2(codes.astype(np.float64) / -_STEPS)


class Trie:
    """Contexts, pointers and successors of one shard, in a memory-mapped file."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, hot: dict[int, int] | None = None):
        """Ascending pairs, context above word, and how often each stands in the training documents.

        A context that is ``hot`` stands as often as that says; any other as often as its successors here do together.
        """
        contexts, words = pairs >> np.uint64(WORD_BITS), pairs & np.uint64((1 << WORD_BITS) - 1)
        own, first = np.unique(contexts, return_index=True)
        pointers = np.append(first, len(contexts)).astype(np.uint64)
        sizes = np.diff(pointers).astype(np.int64)
        rank = np.repeat(np.arange(len(own), dtype=np.uint64), sizes)
        totals = np.add.reduceat(counts, first) if len(own) else np.empty(0, np.int64)
        if hot:
            totals = np.array([hot.get(c, t) for c, t in zip(own.tolist(), totals.tolist(), strict=True)], np.int64)
        codes = quantised(counts / (np.repeat(totals, sizes) + MU))
        levels = [EliasFano.of(own, 1 << CONTEXT_BITS), EliasFano.of(pointers, len(contexts) + 1), EliasFano.of(rank << np.uint64(WORD_BITS) | words, max(1, len(own)) << WORD_BITS)]
        parts = [p for level in levels for p in level.parts()] + [np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint16)]).view(np.uint64)]
        self.file = tempfile.NamedTemporaryFile(prefix="trie-", delete=False)
        self.bytes = sum(p.nbytes for p in parts)
        for p in parts:
            self.file.write(np.ascontiguousarray(p).tobytes())
        self.file.close()
        mapped = np.memmap(self.file.name, np.uint64, "r") if self.bytes else np.empty(0, np.uint64)
        cut = np.cumsum([0, *(p.nbytes // 8 for p in parts)])
        views = [mapped[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        self.contexts, self.pointers, self.successors = (EliasFano.from_parts(views[4 * k : 4 * k + 4]) for k in range(3))
        self.codes = views[12].view(np.uint16)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The quantised probability of each ascending pair, 0 where there is none; codes are one more than stored."""
        contexts, words = pairs >> np.uint64(WORD_BITS), pairs & np.uint64((1 << WORD_BITS) - 1)
        own, back = np.unique(contexts, return_inverse=True)
        rank = self.contexts.find(own)[back]
        known = np.flatnonzero(rank >= 0)
        seen = np.unique(rank[known])
        at = np.searchsorted(seen, rank[known])
        begin, end = self.pointers.get(seen).astype(np.int64), self.pointers.get(seen + 1).astype(np.int64)
        place = self.successors.find(rank[known].astype(np.uint64) << np.uint64(WORD_BITS) | words[known], begin[at], end[at])
        out = np.zeros(len(pairs), np.uint32)
        hit = place >= 0
        out[known[hit]] = self.codes[place[hit]].astype(np.uint32) + 1
        return out

    def close(self) -> None:
        os.unlink(self.file.name)


# --- chunks -------------------------------------------------------------------------------

CHUNKS = "chunk string, doc_ids array<long>, held array<boolean>, lengths array<int>, payload binary, words binary, tokens long"
BLOCKS = "chunk string, shard int, block binary"


def _hashed(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def _by_shard(keys: np.ndarray, shards: int, by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts ascending keys shard by shard (by ``by``, else by themselves), each shard's still ascending; and where each shard begins."""
    by = keys if by is None else by
    mixed = (by ^ (by >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    shard = ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _pair_shards(pairs: np.ndarray, shards: int, hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_by_shard` of pairs by their contexts, but for hot contexts by themselves."""
    contexts = pairs >> np.uint64(WORD_BITS)
    spread = np.isin(contexts, np.array(sorted(hot), np.uint64))
    return _by_shard(pairs, shards, np.where(spread, pairs, contexts))


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, and small counts, both in byte planes."""
    keys = np.concatenate([keys[:1], np.diff(keys)])
    planes = [keys.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()]
    return zlib.compress(b"".join(planes), 1)


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(block), np.uint8).reshape(12, -1)
    keys = np.ascontiguousarray(planes[:8].T).reshape(-1).view("<u8")
    return np.cumsum(keys, dtype=np.uint64), np.ascontiguousarray(planes[8:].T).reshape(-1).view("<u4").astype(np.int64)


class Chunk:
    """A chunk's documents as numbers of its words, with its distinct words and pairs in ascending order."""

    def __init__(self, row: dict, with_pairs: bool = True):
        self.hashes = np.frombuffer(zlib.decompress(row["words"]), "<u8")
        self.lengths = np.asarray(row["lengths"], np.int64)
        self.held = np.asarray(row["held"], bool)
        self.flat = _planes(row["payload"], 4, "<u4").astype(np.int64)
        self.begin = np.concatenate([[0], self.lengths.cumsum()[:-1]])
        before = np.empty(len(self.flat), np.int64)
        before[1:] = self.flat[:-1]
        before[self.begin] = 0  # the end token has number 0
        self.before = before
        self.order = np.argsort(self.hashes)
        if with_pairs:
            context, word = self.hashes >> np.uint64(64 - CONTEXT_BITS), self.hashes >> np.uint64(64 - WORD_BITS)
            self.pairs, self.place = np.unique(context[before] << np.uint64(WORD_BITS) | word[self.flat], return_inverse=True)

    def _blocks(self, keys: np.ndarray, counts: np.ndarray, order: np.ndarray, cut: np.ndarray) -> Iterator[tuple[int, bytes]]:
        for s in np.flatnonzero(np.diff(cut)).tolist():
            own = order[cut[s] : cut[s + 1]]
            yield s, _packed(keys[own], counts[own])

    def word_blocks(self, shards: int) -> Iterator[tuple[int, bytes]]:
        """(shard, block) of the distinct words, each with its count in training documents."""
        weight = np.repeat(~self.held, self.lengths)
        counts = np.bincount(self.flat, weight, len(self.hashes)).astype(np.int64)[self.order]
        words = self.hashes[self.order]
        return self._blocks(words, counts, *_by_shard(words, shards))

    def pair_blocks(self, shards: int, hot: dict[int, int]) -> Iterator[tuple[int, bytes]]:
        """(shard, block) of the distinct pairs, each with its count in training documents."""
        weight = np.repeat(~self.held, self.lengths)
        counts = np.bincount(self.place, weight, len(self.pairs)).astype(np.int64)
        return self._blocks(self.pairs, counts, *_pair_shards(self.pairs, shards, hot))

    def scores(self, singles: list[bytes], pairs: list[bytes], shards: int, hot: dict[int, int], total: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known words, base, score) of each document; answers in the order of their shards."""
        words = self.hashes[self.order]
        counts = np.empty(len(words), np.int64)
        counts[self.order[_by_shard(words, shards)[0]]] = np.concatenate([_planes(x, 8, "<i8") for x in singles])
        codes = np.empty(len(self.pairs), np.uint32)
        codes[_pair_shards(self.pairs, shards, hot)[0]] = np.concatenate([_planes(x, 4, "<u4") for x in pairs])
        unigram = (counts + 1) / (total + vocabulary + 1)
        seen = np.where(codes > 0, restored(np.maximum(codes, 1) - 1), 0.0)[self.place]
        pair = np.log10(seen + MU / (counts[self.before] + MU) * unigram[self.flat])
        return tuple(np.add.reduceat(x, self.begin) for x in ((counts > 0).astype(np.int64)[self.flat], np.log10(unigram)[self.flat], pair))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: defaultdict[str, int] = defaultdict(count().__next__)
    known[END_WORD]
    ids: list[int | None] = []
    held: list[bool] = []
    numbers: list[np.ndarray] = []
    chars, made = 0, 0

    def out() -> pa.RecordBatch:
        lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
        payload = zlib.compress(np.concatenate(numbers).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
        name = f"{TaskContext.get().partitionId()}-{made}"  # the same if the task runs again
        row = [[name], [ids], [held], [lengths.tolist()], [payload], [zlib.compress(_hashed(list(known)).astype("<u8").tobytes(), 1)], [int(lengths[~np.array(held)].sum())]]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["chunk", "doc_ids", "held", "lengths", "payload", "words", "tokens"])

    for batch in batches:
        for doc_id, is_held, words in zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), batch["words"].to_pylist(), strict=True):
            own = words.split(" ") if words else []
            own.append(END_WORD)
            ids.append(doc_id)
            held.append(is_held)
            numbers.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
            chars += len(words) + 1
            if chars >= CHUNK_CHARS:
                yield out()
                known = defaultdict(count().__next__)
                known[END_WORD]
                ids, held, numbers, chars, made = [], [], [], 0, made + 1
    if ids:
        yield out()


_PARTS = ("words", "lengths", "held", "payload")


def _requested(shards: int, hot: dict[int, int] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks of every chunk: of words, or, once the hot contexts are known, of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = Chunk({c: batch[c][row].as_py() for c in _PARTS}, with_pairs=hot is not None)
                found = list(chunk.word_blocks(shards) if hot is None else chunk.pair_blocks(shards, hot))
                yield pa.RecordBatch.from_arrays([pa.array([batch["chunk"][row].as_py()] * len(found)), pa.array([s for s, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["chunk", "shard", "block"])

    return run


COUNTED, ANSWERS = "chunk string, shard int, answer binary, distinct long, hot array<struct<word:long,n:long>>", "chunk string, shard int, answer binary, trie_bytes long"


def _together(blocks: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of all blocks, their summed counts, and where each block's keys stand among them."""
    found = [_unpacked(b.as_py()) for b in blocks]
    distinct, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    total = np.bincount(place, np.concatenate([c for _, c in found]), len(distinct)).astype(np.int64)
    return distinct, total, np.split(place, np.cumsum([len(k) for k, _ in found])[:-1])


def _answers(values: np.ndarray, places: list[np.ndarray], kind: str) -> pa.Array:
    """The values at each block's places, in byte planes."""
    width = np.dtype(kind).itemsize
    return pa.array([zlib.compress(values[at].astype(kind).view(np.uint8).reshape(-1, width).T.tobytes(), 1) for at in places], pa.binary())


def _counted(floor: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """One shard of words: the counts of all chunks for every block; with the first, the number of known words and the words that stand ``floor`` times or more."""

    def run(key: tuple, blocks: pa.Table) -> pa.Table:
        words, total, own = _together(blocks["block"])
        often = [{"word": w, "n": n} for w, n in zip(words[total >= floor].view(np.int64).tolist(), total[total >= floor].tolist(), strict=True)]
        m = blocks.num_rows
        hot = pa.array([often, *[None] * (m - 1)], pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())])))
        return pa.table({"chunk": blocks["chunk"], "shard": blocks["shard"], "answer": _answers(total, own, "<i8"), "distinct": pa.array([int((total > 0).sum())] + [0] * (m - 1), pa.int64()), "hot": hot})

    return run


def _looked_up(hot: dict[int, int]) -> Callable[[tuple, pa.Table], pa.Table]:
    """One shard of pairs: the counts of all chunks, their trie, and its answer to every block."""

    def run(key: tuple, blocks: pa.Table) -> pa.Table:
        pairs, sums, own = _together(blocks["block"])
        trie = Trie(pairs[sums > 0], sums[sums > 0], hot)
        try:
            codes = trie.find(pairs)
        finally:
            trie.close()
        return pa.table({"chunk": blocks["chunk"], "shard": blocks["shard"], "answer": _answers(codes, own, "<u4"), "trie_bytes": pa.array([trie.bytes] + [0] * (blocks.num_rows - 1), pa.int64())})

    return run


def _planes(data: bytes, width: int, kind) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def _scored(shards: int, hot: dict[int, int], total: int, vocabulary: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = Chunk({c: batch[c][row].as_py() for c in _PARTS})
                answers = sorted(batch["answers"][row].as_py(), key=lambda x: x["shard"])
                singles, pairs = ([x["answer"] for x in answers if x["pairs"] == kind] for kind in (False, True))
                known, base, score = chunk.scores(singles, pairs, shards, hot, total, vocabulary)
                columns = [batch["doc_ids"][row].values, pa.array(chunk.held), pa.array(chunk.lengths), pa.array(known), pa.array(np.full(len(known), total)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORES.split(", ")])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, divisor: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model scores of every row, learnt from the rows whose id is not held out."""
    rows = text_rows(docs, id_col, text_col)
    words = F.btrim(F.translate(F.regexp_replace("text", SPACES, " "), UPPER, LOWER), F.lit(" "))
    split = rows.select("doc_id", (id_remainder("doc_id", divisor) == held_out).alias("held_out"), words.alias("words"))
    size = rows.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_CHARS))
    chunks = written(split.mapInArrow(_chunked, CHUNKS), "chunks")
    total = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    parts = chunks.select("chunk", *_PARTS)
    words_asked = parts.mapInArrow(_requested(shards, None), BLOCKS)
    counted = written(words_asked.groupBy("shard").applyInArrow(_counted(max(2, total // (HOT * shards))), COUNTED), "counts")
    vocabulary = counted.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    often = counted.select(F.explode("hot").alias("w")).select("w.*").collect()  # at most HOT for each shard
    hot: dict[int, int] = {}
    for row in often:
        context = (row.word % (1 << 64)) >> (64 - CONTEXT_BITS)
        hot[context] = hot.get(context, 0) + row.n
    answers = written(parts.mapInArrow(_requested(shards, hot), BLOCKS).groupBy("shard").applyInArrow(_looked_up(hot), ANSWERS), "answers")
    both = counted.select("chunk", F.struct(F.lit(False).alias("pairs"), "shard", "answer").alias("a")).unionByName(answers.select("chunk", F.struct(F.lit(True).alias("pairs"), "shard", "answer").alias("a")))
    gathered = both.groupBy("chunk").agg(F.collect_list("a").alias("answers"))
    return chunks.join(gathered.hint("merge"), "chunk").mapInArrow(_scored(shards, hot, total, vocabulary), SCORES)
