"""Groups, splits and subsamples: invariants and refusals."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom import dims
from corpusloom.operators import corpus, groups, split

SCHEMA = "id string, ord long, chapter string, text string, source string, year int, school string, paper string, question_no string, source_file string"


def rows_of(seed=20260814, scarce=40):
    rng = random.Random(seed)
    rows, weights = [], list(range(4, 4 + len(dims.SLUGS)))
    for s in range(17):
        for year in range(2019, 2025):
            for paper in ("I", "P2"):
                if rng.random() < 0.45:
                    continue
                kinds = rng.choices([c for c in dims.SLUGS if c != "sampling"], k=rng.randint(2, 5))
                rows += [(f"t:{s}-{year}-{paper}-{i}", rng.choice(kinds), year, f"S{s}", paper, str(i), None) for i in range(rng.randint(2, 12))]
    for c in dims.SLUGS:
        rows += [(f"tut:{c}:q{i:02d}", c, None, None, None, None, None) for i in range(scarce if c == "sampling" else rng.randint(8, 14))]
    rows += [(f"orphan{i:02d}", dims.SLUGS[i], None, None, None, None, None) for i in range(8)]
    for k in range(6 if scarce > 10 else 0):
        rows.append((f"x:{k}:1", "sampling", 2018, f"T{k}", "I", "1", None))
    rng.shuffle(rows)
    return [(i, n, c, f"text {i}", "topical_pdf", y, s, p, q, f) for n, (i, c, y, s, p, q, f) in enumerate(rows)], weights


@pytest.fixture(scope="module")
def whole(spark):
    return spark.createDataFrame(rows_of()[0], SCHEMA).cache()


@pytest.fixture(scope="module")
def parted(spark, whole):
    return split.split_rows(whole).cache()


def test_split_is_whole_and_covers(spark, whole, parted):
    split.check(whole, parted)
    counts = parted.groupBy("split", "chapter").count().collect()
    n = {(r.split, r.chapter): r["count"] for r in counts}
    assert all(n.get(("test", c), 0) >= 5 and n.get(("val", c), 0) >= 1 and n.get(("train", c), 0) >= 1 for c in dims.SLUGS)
    share = parted.where("split = 'train'").count() / whole.count()
    assert 0.5 < share < 0.85
    again = split.split_rows(whole)
    split.check_reproducible(parted, again)


def test_starved_label_is_refused(spark):
    rows = spark.createDataFrame(rows_of(scarce=4)[0], SCHEMA)
    with pytest.raises(split.ChapterTestShortfallError, match="sampling"):
        split.check(rows, split.split_rows(rows))


def test_refusals(spark, whole, parted):
    with pytest.raises(split.RowConservationError):
        split.split_rows(whole.unionByName(whole.limit(1)))
    with pytest.raises(split.SplitIntegrityError, match="unknown"):
        split.split_rows(whole.withColumn("chapter", F.when(F.col("ord") == 0, "no-such").otherwise(F.col("chapter"))))
    with pytest.raises(split.RowConservationError):
        split.check(whole, parted.where("ord <> 3"))
    with pytest.raises(split.GroupLeakageError):
        split.check(whole, parted.withColumn("split", F.when(F.col("ord") % 2 == 0, "train").otherwise("test")))
    with pytest.raises(split.SplitNotReproducibleError):
        split.check_reproducible(parted, parted.withColumn("split", F.lit("train")))


def test_concentrated_block_is_pinned(spark):
    rows = [(f"p{k}:{i}", "apgp", 2020 + k % 4, f"S{k}", "I", str(i)) for k in range(12) for i in range(4)]
    rows += [(f"p{k}:f", "functions", 2020 + k % 4, f"S{k}", "I", "9") for k in range(6)] + [(f"tut:functions:q{i:02d}", "functions", None, None, None, None) for i in range(20)]
    df = spark.createDataFrame([(a, n, c, "t", "s", y, s, p, q, None) for n, (a, c, y, s, p, q) in enumerate(rows)], SCHEMA)
    found = {r.chapter: r for r in groups.pure_blocks(groups.with_group_key(df)).collect()}
    assert found["functions"].pinned and found["functions"].key.ref == "tut:functions" and not found["apgp"].pinned
    parts = {r.split for r in split.split_rows(df).where("id like 'tut:functions%'").select("split").distinct().collect()}
    assert parts == {"test"}


def test_subsample(spark, parted):
    sizes = []
    for fraction in (0.25, 0.5, 0.75, 1.0):
        part = groups.subsample(parted, fraction)
        split.check_subsample(parted, part)
        sizes.append(part.count())
    assert sizes == sorted(sizes) and sizes[-1] == parted.count()
    shuffled = groups.subsample(parted.orderBy(F.rand(3)), 0.5).select("id")
    assert not shuffled.exceptAll(groups.subsample(parted, 0.5).select("id")).count()
    for bad in (0.0, -0.5, 1.5):
        with pytest.raises(ValueError):
            groups.subsample(parted, bad)
    with pytest.raises(split.SplitIntegrityError):
        split.check_subsample(parted, parted.where("split <> 'test'"))


def test_dedup_first_wins(spark):
    rows = [("a", 0, "x", "t" * 50, "s", 2020, "AB", "II", "Q9", None), ("b", 1, "x", "u" * 50, "s", 2020, "a b", "p 2", "9", None), ("c", 2, "x", "T" * 50, "s", None, None, None, None, None), ("d", 3, "x", "short", "s", None, None, None, None, None), ("e", 4, "x", "short", "s", None, None, None, None, None)]
    kept, counts = corpus.collapse_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.id for r in kept.collect()) == ["a", "d", "e"]
    assert tuple(counts.first()) == (1, 1)


def test_targets_and_weights(spark):
    df = spark.createDataFrame([("a", 100), ("b", 4)], "chapter string, n int").select("chapter", F.explode(F.sequence(F.lit(1), "n")))
    t = {r.chapter: r for r in groups.targets(df).collect()}
    assert abs(t["a"].test - 15) < 1e-9 and abs(t["a"].train - 70) < 1e-9 and t["b"].test == 4.0
    w = {r.chapter: r.weight for r in groups.class_weights(df).collect()}
    assert abs(w["a"] - 104 / 200) < 1e-12 and abs(w["b"] - 13) < 1e-12


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert corpus.collapse_duplicates(empty)[0].count() == 0
    assert groups.straddling(groups.with_group_key(empty).withColumn("split", F.lit("train"))).count() == 0
