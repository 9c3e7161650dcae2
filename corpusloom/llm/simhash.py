"""SimHash fingerprints of documents, and search for fingerprints within a Hamming radius.

Everything here is DataFrame functions. A term is a word with the word after it (the last word
stands alone), lower-cased, split at white space. Its weight is 1 to 4, by the word's length.
Each term's hash votes with its weight on 128 signed bits.

Votes are added in lanes: for each shift j, ``(hash >> j) & 0x0001000100010001`` holds four bits
of the hash in four lanes of 16 bits, so that 32 sums of longs count all 128 bits within
generated code. Terms are summed in runs of ``RUN`` terms, so that no lane overflows (nor the sign
bit); runs are summed in lanes of 32 bits, of which a document's total weight may fill 30.

Search: the 128 bits are cut into ``blocks`` blocks. Two fingerprints within radius r differ in r
blocks at most, so they agree in all others; one table for each choice of ``blocks - r`` blocks,
keyed by their bits, therefore finds every such pair, and the distance is then checked. Distinct
fingerprints are searched, not documents, so copies cost nothing.

Defined results: a null text is empty; the empty text has a fingerprint like any other; equal
texts have equal fingerprints; rows that repeat an id are rows of their own, ordered among
themselves by text; a null id comes last in descending order; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_rows, written

BITS, RUN, BUCKET_ROWS, BOUNDS = 128, 8_000, 8_000, 256
_FOUR, _TWO = 0x0001000100010001, 0x0000FFFF0000FFFF


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def _terms(rows: DataFrame, text: str) -> DataFrame:
    """One row for each term of each row: its run, weight and two hashes."""
    keys = [c for c in rows.columns if c != text]
    words = rows.select(*keys, F.split(F.lower(text), r"\s+").alias("words"))
    pairs = words.select(*keys, F.arrays_zip(F.col("words").alias("w"), F.slice("words", 2, F.size("words")).alias("x")).alias("pairs"))
    each = pairs.select(*keys, F.posexplode("pairs").alias("pos", "pair"))
    word, after = F.col("pair").getField("w"), F.col("pair").getField("x")
    return each.select(*keys, (F.col("pos") / RUN).cast("int").alias("run"), F.least(F.lit(4), F.lit(1) + F.shiftright(F.char_length(word), 2)).cast("long").alias("weight"), F.xxhash64(word, after).alias("a"), F.xxhash64(F.lit(7), after, word).alias("b"))


def fingerprints(rows: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``rows``, which name a row, with ``fp_a`` and ``fp_b``, 64 bits each."""
    keys = [c for c in rows.columns if c != text]
    lanes = [(side, j) for side in "ab" for j in range(16)]
    votes = [F.sum(F.shiftright(side, j).bitwiseAND(_long(_FOUR)) * F.col("weight")).alias(f"{side}{j}") for side, j in lanes]
    runs = _terms(rows, text).groupBy(*keys, "run").agg(F.sum("weight").alias("total"), *votes)
    wide = [F.sum(F.shiftright(f"{side}{j}", 16 * half).bitwiseAND(_long(_TWO))).alias(f"{side}{j}_{half}") for side, j in lanes for half in (0, 1)]
    sums = runs.groupBy(*keys).agg(F.sum("total").alias("total"), *wide)
    # In each lane of 32 bits, bit 30 becomes 1 where twice the votes exceed the total.
    less = _long(0x4000000040000000) - (F.col("total") + 1) * _long(0x0000000100000001)

    def side_bits(side: str) -> Column:
        parts = [F.shiftleft(F.shiftrightunsigned(F.shiftleft(f"{side}{j}_{half}", 1) + less, 30).bitwiseAND(_long(0x0000000100000001)), j + 16 * half) for j in range(16) for half in (0, 1)]
        return reduce(lambda x, y: x.bitwiseOR(y), parts)

    return sums.select(*keys, side_bits("a").alias("fp_a"), side_bits("b").alias("fp_b"))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The Hamming distance of two fingerprints."""
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def as_text(a: Column, b: Column) -> Column:
    """A fingerprint as 32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _blocks(blocks: int) -> list[tuple[int, int]]:
    """The masks of each block of the two halves."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        mask = (1 << high) - (1 << low)
        out.append((mask & ((1 << 64) - 1), mask >> 64))
    return out


def _tables(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Every fingerprint once for each permuted table, with its key there."""
    masks = _blocks(blocks)
    entries = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        low, high = reduce(lambda x, k: (x[0] | masks[k][0], x[1] | masks[k][1]), chosen, (0, 0))
        entries.append(F.struct(F.lit(n).alias("table"), F.col("fp_a").bitwiseAND(_long(low)).alias("key_a"), F.col("fp_b").bitwiseAND(_long(high)).alias("key_b")))
    return fps.select("fp_a", "fp_b", F.explode(F.array(*entries)).alias("at")).select("fp_a", "fp_b", "at.*")


def within(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(q_a, q_b, fp_a, fp_b, distance): of every distinct query fingerprint, all distinct fingerprints within the radius."""
    if not 0 <= radius < blocks:
        raise ValueError("the radius must be less than the number of blocks")
    distinct = _tables(fps.select("fp_a", "fp_b").distinct(), radius, blocks)
    asked = _tables(queries.select("fp_a", "fp_b").distinct(), radius, blocks).withColumnsRenamed({"fp_a": "q_a", "fp_b": "q_b"})
    near = distance((F.col("fp_a"), F.col("fp_b")), (F.col("q_a"), F.col("q_b")))
    return asked.join(distinct, ["table", "key_a", "key_b"]).where(near <= radius).select("q_a", "q_b", "fp_a", "fp_b", near.alias("distance")).distinct()


def _bucketed(rows: DataFrame) -> DataFrame:
    """Rows with a bucket that ascends with the id: even parts between quantiles, about ``BUCKET_ROWS`` rows each."""
    ids = rows.where("doc_id is not null").agg(F.count("*"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [k / BOUNDS for k in range(1, BOUNDS)], 10_000)).first()
    if not ids[0]:
        return rows.withColumn("bucket", F.lit(-1).cast("long"))
    bounds = sorted({ids[1], *ids[3], ids[2] + 1})
    parts = max(1, -(-ids[0] // (BUCKET_ROWS * BOUNDS)))
    step = max(1, -(-BUCKET_ROWS * (len(bounds) - 1) // ids[0]))
    bounds = sorted({*bounds[::step], bounds[-1]})
    lower = F.array(*[F.lit(b).cast("long") for b in bounds[:-1]])
    upper = F.array(*[F.lit(b).cast("long") for b in bounds[1:]])
    at = F.size(F.filter(lower, lambda b: b <= F.col("doc_id")))
    placed = rows.withColumn("at", at)
    low, high = F.get(lower, F.col("at") - 1), F.get(upper, F.col("at") - 1)
    within_part = ((F.col("doc_id") - low) / ((high - low) / F.lit(float(parts)))).cast("long")
    return placed.withColumn("bucket", F.coalesce(F.col("at") * parts + F.least(within_part, F.lit(parts - 1)), F.lit(-1).cast("long"))).drop("at")


def _following(firsts: DataFrame) -> DataFrame:
    """``firsts`` (bucket, ...) under the bucket that they follow: the next higher one; the highest follows the lowest."""
    order = Window.orderBy("bucket")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = firsts.select("bucket").distinct().select("bucket", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(everything)).alias("follows"))
    return firsts.join(pairs.hint("merge"), "bucket").drop("bucket").withColumnRenamed("follows", "bucket")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited text, and that of the next document.

    The next document is the next in descending order of (id, text); the first follows the last.
    The edited text is the text whose last half (rounded down) is replaced by as many of the first
    code points of the next document. Only (id, text) is shuffled, once, by ranges of the id.
    """
    rows = _bucketed(text_rows(docs, id_col, text_col)).withColumn("guest", F.lit(False))
    # The first row of the next bucket is the guest of a bucket, after all its own rows; no text is broadcast.
    firsts = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "text")).alias("top")).select("bucket", "top.doc_id", "top.text", F.lit(True).alias("guest"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    ranked = rows.unionByName(_following(firsts)).withColumns({"rank": F.row_number().over(order), "next": F.lead("text").over(order)})
    joined = ranked.where("not guest")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    both = joined.select("bucket", "rank", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    versions = both.select("bucket", "rank", "doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("edited_sha"), F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("text")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("text")))).alias("v"))
    prints = fingerprints(versions.select("bucket", "rank", "doc_id", "n_chars", "edited_sha", "v.version", "v.text"))
    keys = ["bucket", "rank", "doc_id", "n_chars", "edited_sha"]
    pick = lambda c, k: F.max(F.when(F.col("version") == k, F.col(c)))
    found = written(prints.groupBy(*keys).agg(pick("fp_a", 0).alias("fp_a"), pick("fp_b", 0).alias("fp_b"), pick("fp_a", 1).alias("ed_a"), pick("fp_b", 1).alias("ed_b")), "fingerprints")
    order = Window.partitionBy("bucket").orderBy("rank")
    heads = _following(found.where("rank = 1").select("bucket", F.col("fp_a").alias("first_a"), F.col("fp_b").alias("first_b")))
    led = found.withColumns({"next_a": F.lead("fp_a").over(order), "next_b": F.lead("fp_b").over(order)}).join(heads.hint("merge"), "bucket")
    return led.select("doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), "fp_a", "fp_b", "ed_a", "ed_b", F.coalesce("next_a", "first_a").alias("next_a"), F.coalesce("next_b", "first_b").alias("next_b"))
