"""Group-aware train, validation and test splits.

Which split a group goes to depends on all choices before it, so the choice runs on the driver,
over the label counts of the groups of two rows or more (``MOST_GROUPS`` at most, else it is refused).
Groups of one row, which grow with the rows, reach the driver as one number for each label; how
many of them go where is decided there, and which ones by their place in a seeded hash order, found on the
executors. The assignment is joined back to the rows as a table.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims, tables
from . import corpus, groups
from .groups import FRACTIONS, MIN_TEST_ROWS, SPLITS


class SplitIntegrityError(Exception):
    """A split that must not be written."""


class GroupLeakageError(SplitIntegrityError):
    """A group lies in more than one split."""


class ChapterTestShortfallError(SplitIntegrityError):
    """A label has too few test rows."""


class RowConservationError(SplitIntegrityError):
    """Rows were lost, added or repeated."""


class SplitNotReproducibleError(SplitIntegrityError):
    """The same seed gave another split."""


TRAIN, VAL, TEST = range(3)
MOST_GROUPS = 1_000_000


def dealt(need: list[float], rows: int) -> list[int]:
    """How many of ``rows`` like rows each split gets if each goes where most are still needed; ties go to the first."""
    left, out = list(need), [0] * len(need)
    if rows > 64:
        # The needs sink to one level; all whole steps that end above it are taken at once.
        order = sorted(left, reverse=True)
        for k in range(1, len(order) + 1):
            level = (sum(order[:k]) - (rows - len(order))) / k
            if k == len(order) or level >= order[k]:
                break
        for s, x in enumerate(left):
            out[s] = max(0, int(np.floor(x - level)))
            left[s] -= out[s]
    for _ in range(rows - sum(out)):
        rounded = [round(x, 9) for x in left]
        s = rounded.index(max(rounded))
        out[s] += 1
        left[s] -= 1
    return out


class Assignment:
    """The state of an assignment: where each group lies, and what is placed.

    ``counts`` is groups by labels, in order of first sight; ``singles`` the number of groups of one row by label.
    """

    def __init__(self, counts: np.ndarray, singles: np.ndarray, min_test_rows: int):
        self.counts, self.sizes, self.floor = counts, counts.sum(axis=1), min_test_rows
        totals = counts.sum(axis=0) + singles
        test = np.maximum(FRACTIONS["test"] * totals, np.minimum(min_test_rows, totals))
        share = FRACTIONS["train"] / (FRACTIONS["train"] + FRACTIONS["val"])
        self.totals, self.wanted = totals, np.stack([(totals - test) * share, (totals - test) * (1 - share), test])
        self.singles = np.zeros((3, counts.shape[1]), np.int64)
        self.placed = np.zeros((3, counts.shape[1]), np.int64)
        self.where = np.full(len(counts), -1)
        self.moved: list[int] = []  # groups in the order in which they were first placed

    def put(self, group: int, split: int) -> None:
        if self.where[group] < 0:
            self.moved.append(group)
        else:
            self.placed[self.where[group]] -= self.counts[group]
        self.where[group] = split
        self.placed[split] += self.counts[group]

    def pin_concentrated(self) -> None:
        """A label's largest block goes to test if it fills the floor and the rest of the label hardly could."""
        pure = np.flatnonzero((self.counts > 0).sum(axis=1) == 1)
        label_of = self.counts[pure].argmax(axis=1)
        for label in dict.fromkeys(label_of.tolist()):
            own = pure[label_of == label]
            block = int(own[self.counts[own, label].argmax()])
            if self.sizes[block] >= self.floor and self.totals[label] - self.sizes[block] < self.floor + 2:
                self.put(block, TEST)

    def fill(self, seed: int) -> None:
        """The other groups, largest first, go where most of their rows are still wanted; then the single rows."""
        order = np.flatnonzero(self.where < 0).tolist()
        random.Random(seed).shuffle(order)
        for group in sorted(order, key=lambda g: -self.sizes[g]):
            need = np.round((self.wanted - self.placed) @ self.counts[group].astype(np.float64), 9)
            self.put(group, int(need.argmax()))

    def fill_singles(self, singles: np.ndarray) -> None:
        for label, n in enumerate(singles.tolist()):
            self.singles[:, label] = dealt((self.wanted - self.placed)[:, label].tolist(), n)
        self.placed += self.singles

    def cover(self, split: int, floor: int, floors: dict[int, int]) -> None:
        """Bring every label to ``floor`` rows in a split by moving whole groups, the least wasteful first, out of splits that stay above their own floors."""
        least = np.array([floors.get(s, -1) for s in range(3)])
        for label in range(self.counts.shape[1]):
            while (short := floor - self.placed[split, label]) > 0:
                movable = np.array([g for g in self.moved if self.where[g] != split and self.counts[g, label] > 0], np.int64)
                if len(movable):
                    home, own = self.where[movable], self.counts[movable]
                    movable = movable[((self.placed[home] - own >= least[home][:, None]) | (own == 0)).all(axis=1)]
                group = min(movable.tolist(), key=lambda g: (self.sizes[g] - min(self.counts[g, label], short), -self.counts[g, label]), default=None)
                homes = [h for h in range(3) if h != split and self.singles[h, label] and self.placed[h, label] - 1 >= least[h]]
                waste = None if group is None else self.sizes[group] - min(self.counts[group, label], short)
                if homes and waste != 0:
                    step = np.zeros((3, self.counts.shape[1]), np.int64)
                    step[homes[0], label], step[split, label] = -1, 1
                    self.singles += step
                    self.placed += step
                elif group is not None:
                    self.put(group, split)
                else:
                    break


def assign(counts: np.ndarray, seed: int = 42, min_test_rows: int = MIN_TEST_ROWS, singles: np.ndarray | None = None) -> tuple[list[int], np.ndarray]:
    """The split (0 train, 1 val, 2 test) of each group, and how many single rows of each label each split gets.

    Concentrated labels are pinned to test; the others go, largest first, where most rows are
    still wanted; then whole groups move until every label reaches its floor in test, in
    validation and in training, in this order.
    """
    singles = np.zeros(counts.shape[1], np.int64) if singles is None else singles
    state = Assignment(counts, singles, min_test_rows)
    state.pin_concentrated()
    state.fill(seed)
    state.fill_singles(singles)
    floors: dict[int, int] = {}
    for split, floor in ((TEST, min_test_rows), (VAL, 1), (TRAIN, 1)):
        state.cover(split, floor, floors)
        floors[split] = floor
    return state.where.tolist(), state.singles


def split_rows(rows: DataFrame, seed: int = 42, min_test_rows: int = MIN_TEST_ROWS, labels: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``key`` and ``split``; ids and labels are checked first."""
    spark: SparkSession = rows.sparkSession
    labels = dims.labels(spark) if labels is None else labels
    corpus_ids = [str(r.id) for r in corpus.bad_ids(rows).orderBy("id").limit(5).collect()]
    if corpus_ids:
        raise RowConservationError(f"every row needs an id of its own; not so: {corpus_ids}")
    unknown = [r.chapter for r in corpus.unknown_labels(rows, labels).collect()]
    if unknown:
        raise SplitIntegrityError(f"labels unknown to the dictionary: {sorted(map(str, unknown))}")
    keyed = groups.with_group_key(rows)
    slugs = [r.slug for r in labels.orderBy("class_id").collect()]
    of_label = [F.count_if(F.col("chapter") == x).alias(f"c{i}") for i, x in enumerate(slugs)]
    found = tables.written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.first("chapter").alias("chapter"), F.array(*of_label).alias("counts")), "groups")
    single = F.col("n") == 1 if min_test_rows > 1 else F.lit(False)
    alone = found.where(single)
    together = found.where(~single).orderBy("first_ord").limit(MOST_GROUPS + 1).collect()
    if len(together) > MOST_GROUPS:
        raise SplitIntegrityError(f"more than {MOST_GROUPS} groups of several rows")
    counts = np.array([r.counts for r in together], np.int64).reshape(len(together), len(slugs))
    by_label = {r.chapter: r.n for r in alone.groupBy("chapter").agg(F.count("*").alias("n")).collect()}
    splits, placed = assign(counts, seed, min_test_rows, np.array([by_label.get(x, 0) for x in slugs], np.int64))
    schema = found.select("key").schema.add("split", "string")
    table = spark.createDataFrame([(r.key, SPLITS[s]) for r, s in zip(together, splits, strict=True)], schema)
    shares = spark.createDataFrame([(x, int(placed[0, i]), int(placed[0, i] + placed[1, i])) for i, x in enumerate(slugs)], "slug string, train long, val long")
    named = alone.withColumns({"_name": groups.key_name(), "one": F.lit(1)})
    ranked = groups.sums_before(named.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), "_name"))), "chapter", "_h", "_name", weight="one")
    ranked = ranked.join(F.broadcast(shares), ranked.chapter == shares.slug)  # one row for each label
    own = F.when(F.col("before") < F.col("train"), SPLITS[0]).when(F.col("before") < F.col("val"), SPLITS[1]).otherwise(SPLITS[2])
    both = table.unionByName(ranked.select("key", own.alias("split"))).withColumnRenamed("key", "_key")
    return keyed.join(both, keyed.key.eqNullSafe(both["_key"])).drop("_key")


def check(rows: DataFrame, split: DataFrame, labels: DataFrame | None = None, min_test_rows: int = MIN_TEST_ROWS) -> None:
    """Raise unless the split keeps groups whole, loses no row and meets every floor of the labels that occur."""
    leaks = groups.straddling(split).limit(3).collect()
    if leaks:
        raise GroupLeakageError(f"groups in more than one split: {[tuple(x.key) for x in leaks]}")
    moved = groups.lost_and_added(rows, split).limit(5).collect()
    if moved:
        raise RowConservationError(f"rows lost or added: {[(x.side, x.id) for x in moved]}")
    labels = dims.labels(rows.sparkSession) if labels is None else labels
    short = groups.short_labels(split, labels, "test", min_test_rows).collect()
    if short:
        raise ChapterTestShortfallError(f"too few test rows: {[(x.slug, x.n) for x in short]}")


def check_reproducible(first: DataFrame, second: DataFrame) -> None:
    """Raise unless both frames put every id into the same split."""
    if first.select("id", "split").exceptAll(second.select("id", "split")).limit(1).count():
        raise SplitNotReproducibleError("the same seed gave another split")


def check_subsample(whole: DataFrame, part: DataFrame) -> None:
    """Raise unless test is untouched, groups are whole, no row is new and nothing is empty."""
    if groups.lost_and_added(whole.where("split = 'test'"), part.where("split = 'test'")).limit(1).count():
        raise SplitIntegrityError("the test split moved")
    sizes = whole.groupBy("split", "key").agg(F.count("*").alias("n"))
    own = part.groupBy(F.col("split").alias("s"), F.col("key").alias("k")).agg(F.count("*").alias("m"))
    if own.join(sizes, own.s.eqNullSafe(sizes.split) & own.k.eqNullSafe(sizes.key), "left").where("n is null or n <> m").limit(1).count():
        raise SplitIntegrityError("a group is kept in part, or rows were invented or repeated")
    present = {r.split for r in part.select("split").distinct().collect()}
    if not {"train", "val"} <= present:
        raise SplitIntegrityError("nothing is left to train or to tune on")
