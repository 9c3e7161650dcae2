"""Near-duplicate detection by improved consistent weighted sampling.

A document is the weighted set of its shingles of five words, lower-cased and split at white
space (a shorter document is one shingle). The weight of a shingle is its count in the document
times ``1 + ln((1 + N) / (1 + df)) / ln(2 + N)``, a smoothed inverse document frequency between
1 and 2. Document frequencies are exact counts over all documents: chunks of documents send their
sorted shingle hashes (``HASH_BITS`` bits) to shards by range, as many as the input asks for, which send
back the count of each. A chunk sends nothing to a shard that it has no hash for, so there are never more
blocks than hashes. Every distinct text then has the frequencies of its own shingles beside it.

Equal texts are one node. Every node gets ``BANDS`` x ``ROWS`` samples; each is equal for two
documents with a probability of their weighted Jaccard similarity. The variates of a (sample,
shingle) come from fixed tables at a hashed place. Nodes whose samples agree in a whole band
share a bucket.

Within a bucket the most central node leads, the one whose buckets hold most nodes together, and
every other node is verified against it by the weighted Jaccard similarity of their whole texts.
In a group of near copies that is nearly always the text that the others were made from, so a
group of any size costs as many comparisons as it has nodes. The pairs of a leader are dealt over
tasks of ``SPREAD`` pairs, each with its own copy of the leader's text.

Nodes that fail are compared with every node of their bucket that is not of their class already, by
bounds first: blocks of at most ``BLOCK_NODES`` of them meet blocks of all nodes of the bucket. The
weights of a node are summed in ``PLACES`` places by hash; the lesser sums of two nodes bound what
they share from above, so a pair at the threshold always stays open, and every open pair is verified
by its texts too. No bucket, partner or candidate is capped. Links become classes as connected components.

Defined results: a null text is empty; empty texts form one class; a class is named by its
least non-null id (null if it has none); rows that repeat an id keep their own classes, and all
of them come out; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_keys, one_of_each, removed, text_rows, written
from .components import components

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 14, 4
CHUNK, SHARD = 1 << 20, 1 << 21
BLOCK_NODES, PLACES, SPREAD, HASH_BITS, KNOWN_WORDS = 2_048, 512, 2_000, 52, 200_000
_VARIATE_BITS = 14
_BLOCK = 1 << 12


def _node(text: Column | str) -> Column:
    """The node of a text: 128 bits of its SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    """The hash of each word seen so far; forgotten beyond ``KNOWN_WORDS``."""

    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_WORDS = _Hashes()


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct shingles of a text, ascending, and their counts."""
    own = text.lower().split()
    if len(_WORDS) > KNOWN_WORDS:
        _WORDS.clear()
    hashes = np.fromiter(map(_WORDS.__getitem__, own), np.uint64, len(own))
    n = max(1, len(hashes) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(hashes))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    out = np.sort(_mixed(out) >> np.uint64(64 - HASH_BITS))
    first = np.flatnonzero(np.concatenate([[True], out[1:] != out[:-1]]))
    return out[first], np.diff(first, append=n)


def weights(hashes: np.ndarray, counts: np.ndarray, idf: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """TF-IDF of each shingle."""
    return counts * idf(hashes)


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    """The smoothed inverse of document frequencies among n documents."""
    return (1 + np.log((1 + n) / (1 + np.minimum(df.astype(np.float64), n))) / np.log(2 + n)).astype(np.float32)


def weighted(text: str, df: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a text, ascending, and their weights; ``df`` as :func:`frequencies` gives it."""
    hashes, counts = shingles(text)
    return hashes, counts * inverse(np.frombuffer(zlib.decompress(df), np.uint32), n)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (hashes, weights)."""
    _, left, right = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][left], b[1][right]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


class Sampler:
    """Consistent weighted samples: r and c of a Gamma(2, 1), beta uniform, by shingle and sample."""

    def __init__(self, samples: int = BANDS * ROWS):
        rng = np.random.default_rng(20_100_131)
        n = 1 << _VARIATE_BITS
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.beta = rng.random(n, np.float32)
        self.by_r = (1 / self.r).astype(np.float32)
        self.constant = self.ln_c - self.r + self.r * self.beta
        self.odd = rng.integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
        self.samples = samples

    def __call__(self, hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One value for each sample: the shingle of the least a = c / (y e^r), with its t."""
        ln_w = np.log(weight).astype(np.float32)
        best = np.full(self.samples, np.inf, np.float32)
        out = np.zeros(self.samples, np.uint64)
        rows = np.arange(self.samples)
        for at in range(0, len(hashes), _BLOCK):
            h, w = hashes[at : at + _BLOCK], ln_w[at : at + _BLOCK]
            place = ((h[None, :] * self.odd[:, None]) >> np.uint64(64 - _VARIATE_BITS)).view(np.int64)
            t = self.by_r.take(place, mode="clip")
            t *= w
            t += self.beta.take(place, mode="clip")
            np.floor(t, out=t)
            ln_a = self.r.take(place, mode="clip")
            ln_a *= t
            np.subtract(self.constant.take(place, mode="clip"), ln_a, out=ln_a)
            least = ln_a.argmin(axis=1)
            value = ln_a[rows, least]
            better = value < best
            best[better] = value[better]
            found = _mixed(h[least]) ^ _mixed(t[rows, least].astype(np.int64).astype(np.uint64) + self.odd)
            out[better] = found[better]
        return out

    def bands(self, samples: np.ndarray, rows: int = ROWS) -> np.ndarray:
        """One key for each band of ``rows`` samples; of several texts one after the other."""
        samples = samples.reshape(-1, rows)
        key = np.zeros(len(samples), np.uint64)
        for k in range(rows):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, k])
        return key.view(np.int64)


def _planes(ascending: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte of all: the high bytes are zeros and compress."""
    return np.diff(ascending, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _ascending(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel().cumsum(dtype=np.uint64)


_SENT = "shard int, chunk long, hashes binary, times binary, owners binary, nodes binary"
_REPLY = "shard int, chunk long, df binary, times binary, owners binary, nodes binary"


def _sent(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of documents by shard: distinct hashes, how many documents have each, and which."""

    def chunk(number: int, nodes: list[bytes], found: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(found)
        order = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[order], np.repeat(np.arange(len(found), dtype=np.uint16), [len(x) for x in found])[order]
        cuts = np.searchsorted((hashes >> np.uint64(HASH_BITS - 32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))
        out = []
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = hashes[cuts[k] : cuts[k + 1]]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            times = np.diff(first, append=len(own)).astype(np.uint16)
            out.append((k, number, _planes(own[first]), times.tobytes(), owners[cuts[k] : cuts[k + 1]].tobytes(), b"" if out else b"".join(nodes)))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "chunk", "hashes", "times", "owners", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        nodes, found, size = [], [], 0
        for batch in batches:
            for node, text in zip(batch["node"].to_pylist(), batch["text"].to_pylist(), strict=True):
                nodes.append(node)
                found.append(shingles(text)[0])
                size += len(found[-1])
                if size >= CHUNK or len(nodes) == 65_535:
                    yield chunk(number, nodes, found)
                    nodes, found, size, number = [], [], 0, number + 1
        if nodes:
            yield chunk(number, nodes, found)

    return run


def _replied(key: tuple, rows: pa.Table) -> pa.Table:
    """The document frequencies of one shard's hashes over all chunks, for each chunk."""
    parts = [_ascending(x.as_py()) for x in rows["hashes"]]
    times = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in rows["times"]])
    _, place = np.unique(np.concatenate(parts), return_inverse=True)
    df = np.bincount(place, weights=times)[place].astype(np.uint32)
    replies = [zlib.compress(x.tobytes(), 1) for x in np.split(df, np.cumsum([len(x) for x in parts])[:-1])]
    return pa.table({"shard": rows["shard"], "chunk": rows["chunk"], "df": pa.array(replies, pa.binary()), "times": rows["times"], "owners": rows["owners"], "nodes": rows["nodes"]})


def _gathered(key: tuple, rows: pa.Table) -> pa.Table:
    """One chunk's replies, by document: shards ascend as hashes do, so each document's are in order."""
    rows = rows.sort_by("shard")
    read = lambda name: [x.as_py() for x in rows[name]]
    df = np.concatenate([np.repeat(np.frombuffer(zlib.decompress(x), np.uint32), np.frombuffer(t, np.uint16)) for x, t in zip(read("df"), read("times"), strict=True)])
    owners, nodes = np.frombuffer(b"".join(read("owners")), np.uint16), b"".join(read("nodes"))
    df = df[np.argsort(owners, kind="stable")]
    ends = np.bincount(owners, minlength=len(nodes) // 16).cumsum()
    return pa.table({"node": pa.array([nodes[at : at + 16] for at in range(0, len(nodes), 16)], pa.binary()), "df": pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(df, ends[:-1])], pa.binary())})


def frequencies(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (node, text): of each node the document frequencies of its shingles, ascending by hash, and the number of rows."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    sent = rows.select("node", "text").mapInArrow(_sent(1 + int(size) // (6 * SHARD)), _SENT)  # a word has some six characters
    replies = sent.groupBy("shard").applyInArrow(_replied, _REPLY)
    found = replies.groupBy("chunk").applyInArrow(_gathered, "node binary, df binary")
    return written(found.groupBy("node").agg(F.first("df").alias("df")), "frequencies"), n


def inverse_frequencies(rows: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A lookup of inverse document frequencies by hash, for tables that the driver can hold."""
    rows = rows.select(_node("text").alias("node"), "text")
    found, n = frequencies(rows)
    table: dict[int, int] = {}
    for row in rows.dropDuplicates(["node"]).join(found, "node").collect():
        table.update(zip(shingles(row.text)[0].tolist(), np.frombuffer(zlib.decompress(row.df), np.uint32).tolist(), strict=True))
    return lambda hashes: inverse(np.array([table[h] for h in hashes.tolist()], np.uint32), n)


def _sampled(n_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            n = batch.num_rows
            samples = [sampler(*weighted(text, df, n_docs)) for text, df in zip(batch["text"].to_pylist(), batch["df"].to_pylist(), strict=True)]
            flat = sampler.bands(np.concatenate(samples)) if n else np.empty(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["node"], bands], names=["doc_id", "node", "bands"])

    return run


def summed(hashes: np.ndarray, weight: np.ndarray) -> bytes:
    """The total weight, then the weight at each of ``PLACES`` places in two bytes, rounded up."""
    exact = np.bincount((hashes % np.uint64(PLACES)).astype(np.int64), weight, PLACES)
    with np.errstate(over="ignore"):
        places = exact.astype(np.float16)
    low = places.astype(np.float64) < exact
    places[low] = np.nextafter(places[low], np.float16(np.inf))
    return np.float64(exact.sum()).tobytes() + places.tobytes()


def may_reach(total: float, places: np.ndarray, totals: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Which of the others could be as similar as ``least``: False only where none of it is possible."""
    least *= 1 - 1e-4  # for rounding
    out = np.minimum(total, totals) >= least * np.maximum(total, totals)
    shared = np.minimum(others[out], places).sum(axis=1, dtype=np.float64)
    out[out] = shared >= least * (total + totals[out] - shared)
    return out


def _marked(n_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The band keys of each text, then its summed weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            marks = []
            for text, df in zip(batch["text"].to_pylist(), batch["df"].to_pylist(), strict=True):
                hashes, weight = weighted(text, df, n_docs)
                marks.append(sampler.bands(sampler(hashes, weight)).tobytes() + summed(hashes, weight))
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(marks, pa.binary())], names=["node", "samples"])

    return run


def _verified(n_docs: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, vector = None, None
        for batch in batches:
            out = []
            for name, own, df, text, leader_df in zip(*[batch[c].to_pylist() for c in ("leader", "text", "df", "leader_text", "leader_df")], strict=True):
                if name != leader:
                    leader, vector = name, weighted(text, leader_df, n_docs)
                out.append(similarity(weighted(own, df, n_docs), vector) >= least)
            yield pa.RecordBatch.from_arrays([batch["node"], batch["leader"], pa.array(out, pa.bool_())], names=["node", "leader", "linked"])

    return run


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node (128 bits of the SHA-256 of the text) and text of every row."""
    return text_rows(docs, id_col, text_col).select("doc_id", _node("text").alias("node"), "text")


def _bounded(least: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """A block of failed nodes against a block of the nodes of their bucket: the pairs that their bounds leave open."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return _open_pairs(key[0].as_py(), rows, least)

    return run


def _open_pairs(band: int, rows: pa.Table, least: float) -> pa.Table:
    """A pair is judged in the first band that it shares: of two nodes of different classes, one has failed in every bucket that they share."""
    both = np.frombuffer(b"".join(rows["samples"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    keys = np.ascontiguousarray(both[:, : 8 * band]).view(np.int64)
    totals = np.ascontiguousarray(both[:, 8 * BANDS : 8 * BANDS + 8]).view(np.float64).ravel()
    places = np.ascontiguousarray(both[:, 8 * BANDS + 8 :]).view(np.float16).astype(np.float32)
    failed = np.flatnonzero(rows["failed"].to_numpy(zero_copy_only=False))
    others = np.flatnonzero(~rows["failed"].to_numpy(zero_copy_only=False))
    labels = np.unique(np.array(rows["label"].to_pylist(), object), return_inverse=True)[1]
    nodes = rows["node"]
    left, right = [], []
    for at in failed.tolist():
        strangers = others[labels[others] != labels[at]]
        strangers = strangers[~(keys[strangers] == keys[at]).any(axis=1)]
        near = strangers[may_reach(totals[at], places[at], totals[strangers], places[strangers], least)]
        left += [at] * len(near)
        right += near.tolist()
    u, v = nodes.take(pa.array(left, pa.int64())), nodes.take(pa.array(right, pa.int64()))
    return pa.table({"node": u, "head": v})


def _rest(shared: DataFrame, failed: DataFrame, labels: DataFrame, texts: DataFrame, n_docs: int, least: float) -> DataFrame:
    """The open pairs (node, head) of failed nodes with the nodes of other classes (node, label) in their buckets."""
    named = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("band", "key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("band", "key")
    named = written(named.join(mixed, ["band", "key"], "left_semi"), "mixed")
    bad = written(failed.join(named, (named.node == failed.n) & (named.leader == failed.l)).select("band", "key", "node", "label"), "failed")
    sizes = bad.groupBy("band", "key").agg(F.count("*").alias("n_failed"))
    everyone = named.select("band", "key", "node", "label").join(sizes, ["band", "key"])
    counts = everyone.groupBy("band", "key").agg(F.first("n_failed").alias("n_failed"), F.count("*").alias("n"))
    lefts, rights = F.ceil(F.col("n_failed") / BLOCK_NODES).cast("int"), F.ceil(F.col("n") / BLOCK_NODES).cast("int")
    own, every = F.pmod(F.xxhash64("node"), lefts).cast("int"), F.pmod(F.xxhash64("node"), rights).cast("int")
    left = bad.join(counts, ["band", "key"]).select("band", "key", "node", "label", F.lit(True).alias("failed"), own.alias("i"), F.explode(F.sequence(F.lit(0), rights - 1)).alias("j"))
    right = everyone.drop("n_failed").join(counts, ["band", "key"]).select("band", "key", "node", "label", F.lit(False).alias("failed"), F.explode(F.sequence(F.lit(0), lefts - 1)).alias("i"), every.alias("j"))
    marks = texts.join(everyone.select("node").distinct(), "node", "left_semi").mapInArrow(_marked(n_docs), "node binary, samples binary")
    blocks = left.unionByName(right).join(marks, "node")
    return blocks.groupBy("band", "key", "i", "j").applyInArrow(_bounded(least), "node binary, head binary").where("node != head").distinct()


def near_links(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc_id, node, text): the rows without text, and the verified links (u, v) between nodes."""
    ids = written(rows.select("doc_id", "node"), "ids")
    known, n_docs = frequencies(rows)
    # Texts always meet by sorted shuffles, so that the plan is the same at every size.
    heads = ids.groupBy("node").agg(F.min("doc_id").alias("id")).join(known, "node").select(F.col("node").alias("head"), F.col("id").alias("head_id"), "df")
    distinct = rows.join(heads.hint("merge"), (rows.node == heads["head"]) & rows.doc_id.eqNullSafe(heads.head_id)).select("doc_id", "node", "text", "df")
    sampled = written(distinct.mapInArrow(_sampled(n_docs), "doc_id long, node binary, bands array<long>"), "samples")
    nodes = sampled.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    entries = nodes.select("node", "id", F.posexplode("bands").alias("band", "key"))
    sizes = entries.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(entries.join(sizes, ["band", "key"]), "buckets")
    removed(sampled)
    central = written(buckets.groupBy("node", "id").agg(F.sum("n").alias("central")), "candidates")
    ranked = buckets.join(central.select("node", "central"), "node")
    leaders = ranked.groupBy("band", "key").agg(F.max(F.struct("central", "node", "id")).alias("top")).select("band", "key", F.col("top.node").alias("leader"), F.col("top.id").alias("leader_id"))
    shared = written(buckets.join(leaders, ["band", "key"]).select("band", "key", "node", "id", "leader", "leader_id"), "led")
    removed(buckets)
    wanted = central.join(known, "node").select(F.col("node").alias("wanted"), F.col("id").alias("wanted_id"), "df")
    texts = rows.join(wanted.hint("merge"), (rows.node == wanted.wanted) & rows.doc_id.eqNullSafe(wanted.wanted_id)).select("node", "text", "df")
    texts = written(texts.dropDuplicates(["node"]), "candidate-texts")
    removed(known, central)

    def verified(pairs: DataFrame) -> DataFrame:
        """``pairs`` (node, head) judged by their texts: node, leader, linked."""
        parts = F.ceil(F.col("n") / SPREAD).cast("int")
        sizes = pairs.groupBy("head").agg(F.count("*").alias("n"))
        dealt = pairs.join(sizes.hint("merge"), "head").select("node", "head", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
        heads = texts.join(sizes.hint("merge"), texts.node == sizes["head"]).select("head", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("text").alias("leader_text"), F.col("df").alias("leader_df"))
        both = dealt.hint("merge").join(texts, "node").hint("merge").join(heads, ["head", "part"]).select("node", F.col("head").alias("leader"), "text", "df", "leader_text", "leader_df")
        return written(both.mapInArrow(_verified(n_docs, least), "node binary, leader binary, linked boolean"), "verified")

    judged = verified(shared.where("node != leader").select("node", F.col("leader").alias("head")).distinct())
    failed = judged.where("not linked").select(F.col("node").alias("n"), F.col("leader").alias("l"))
    tried = judged.select(F.col("node").alias("a"), F.col("leader").alias("b"))
    labels = components(judged.where("linked").select(F.col("node").alias("u"), F.col("leader").alias("v")))
    pairs = _rest(shared, failed, labels, texts, n_docs, least).select(F.least("node", "head").alias("node"), F.greatest("node", "head").alias("head")).distinct()
    seen = tried.select(F.least("a", "b").alias("node"), F.greatest("a", "b").alias("head")).distinct()
    rest = verified(pairs.join(seen, ["node", "head"], "left_anti"))
    links = written(judged.where("linked").unionByName(rest.where("linked")).select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct(), "links")
    removed(shared, texts, judged, rest)
    return ids, links


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, links, node and class_node of every row; the class is named by its least id.

    ``links`` is the number of other texts that the row's text was verified to be as similar to as ``least``.
    """
    rows, links = near_links(_nodes(docs, id_col, text_col), least)
    labels = components(links)
    counts = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().groupBy(F.col("u").alias("node")).agg(F.count("*").alias("links"))
    ids = rows.groupBy("node").agg(F.min("doc_id").alias("id"))
    labelled = written(ids.join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label")), "labels")
    names = labelled.groupBy("label").agg(F.min("id").alias("class_id"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "node"))).alias("first"), F.min("node").alias("least_node"))
    named = labelled.join(names, "label").join(counts, "node", "left")
    classes = named.select("node", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("first.node", "least_node").alias("class_node"))
    return rows.join(classes, "node").select("doc_id", "class_id", "links", "node", "class_node")


def keep_one(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each class: its least id (of rows that repeat it, one)."""
    found = near_duplicates(docs, least, id_col, text_col)
    stays = found.where((F.col("node") == F.col("class_node")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    stays = stays.select("node", *[v.alias(k) for k, v in id_keys(F.col("doc_id")).items()]).distinct()
    return one_of_each(docs, {"node": _node(F.coalesce(docs[text_col], F.lit(""))), **id_keys(docs[id_col])}, stays)
