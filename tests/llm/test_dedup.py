"""Exact dedup, line dedup, near duplicates, fingerprints, sharding against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import common, components, exact_dedup, line_dedup, near_dedup, sharding, simhash


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


# --- exact dedup ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ar"), st.integers(0, 60), st.integers(0, 1000)), max_size=400))
def test_cuckoo_index_against_dict(steps):
    index, plain = exact_dedup.CuckooIndex(2), {}
    for action, key, keep in steps:
        d = hashlib.sha256(str(key).encode()).digest()
        if action == "a":
            assert index.add(d, keep, 1) == (d not in plain)
            old = plain.get(d)
            plain[d] = (keep, 1) if old is None else (min(old[0], keep), old[1] + 1)
        else:
            assert index.remove(d) == (plain.pop(d, None) is not None)
        assert index.get(d) == plain.get(d)
    assert {k: (a, b) for k, a, b in index.items()} == plain


def test_cuckoo_tags_are_verified():
    index = exact_dedup.CuckooIndex(2)
    a = bytes(8) + b"\x01\x00" + bytes(22)
    b = bytes(8) + b"\x01\x00" + bytes(8) + b"\x01" * 14  # the same tag and buckets
    assert index.add(a, 1, 1) and index.get(b) is None and index.add(b, 2, 1) and index.remove(a) and index.get(b) == (2, 1)


def test_exact_duplicates(spark, documents, awkward):
    rows = [*awkward, (9, "spaced  out"), (0, "spaced\tout")]
    found = exact_dedup.exact_duplicates(documents(rows)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).digest()].append(i)
    want = sorted((str(i), str(min((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in found) == want
    kept = exact_dedup.keep_first(documents(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(documents([])).count() == 0 and exact_dedup.keep_first(documents([])).count() == 0


def test_index_updates(spark, documents):
    index = exact_dedup.build_index(documents([(1, "a"), (2, "b"), (3, "a")]), 2)
    index = exact_dedup.update_index(index, documents([(0, "b"), (4, "c")]), 2)
    assert sorted((r.keep_id, r.rows) for r in index.collect()) == [(0, 2), (1, 2), (4, 1)]
    index = exact_dedup.update_index(index, documents([(9, "a"), (9, "z")]), 2, delete=True)
    assert sorted((r.keep_id, r.rows) for r in index.collect()) == [(0, 2), (4, 1)]


# --- line dedup ---


def plain_lines(rows, least):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    seen = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 1 and len(seen[key(x)]) >= least)]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_lines_against_counting(spark, documents, awkward, batch):
    rng = random.Random(1)
    lines = ["Common Line", " common line\t", "other", "", "Z"] + [" ".join(words(rng, 3)) for _ in range(30)]
    rows = [(100 + i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 8)))) for i in range(60)] + awkward
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = line_dedup.without_lines(documents(rows), 10).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in found) == plain_lines(rows, 10)


def test_first_occurrences_stay(spark, documents):
    rows = [(3, "a\nb\na"), (1, "b\nc"), (2, "c\nA\nd")]
    found = {r.doc_id: r.kept_text for r in line_dedup.without_lines(documents(rows), keep_first=True).collect()}
    assert found == {1: "b\nc", 2: "A\nd", 3: ""}
    assert line_dedup.without_lines(documents([])).count() == 0
    assert list(line_dedup.unpacked(line_dedup.packed([1, 9], 11), 11)) == [i not in (1, 9) for i in range(11)]


# --- near duplicates ---


def test_samples_agree_as_similarity():
    rng = random.Random(3)
    sampler = near_dedup.Sampler(2_000)
    text = words(rng, 200)
    other = text[:130] + words(rng, 60)
    a, b = (near_dedup.shingles(" ".join(t)) for t in (text, other))
    weigh = lambda x: (x[0], x[1] * (1.0 + (x[0] % np.uint64(7)).astype(float) / 7))
    a, b = weigh(a), weigh(b)
    share = (sampler(*a) == sampler(*b)).mean()
    assert abs(share - near_dedup.similarity(a, b)) < 0.04


def test_near_classes_against_all_pairs(spark, documents, awkward):
    rng = random.Random(5)
    rows = list(awkward)
    for group in range(12):
        base = words(rng, 120)
        for copy in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(120)] = "edit" + str(rng.randrange(1000))
            rows.append((1000 + group * 50 + copy, " ".join(own)))
    docs = documents(rows)
    idf = near_dedup.inverse_frequencies(common.text_rows(docs))
    vectors = [(h, near_dedup.weights(h, c, idf)) for h, c in (near_dedup.shingles(t or "") for _, t in rows)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or near_dedup.similarity(vectors[i], vectors[j]) >= 0.8:
                parent[root(i)] = root(j)
    want = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        want[root(i)].append(str(doc))
    got = collections.defaultdict(list)
    for r in near_dedup.near_duplicates(docs).collect():
        got[r.class_node].append(str(r.doc_id))
        assert r.class_id is not None or r.doc_id is None
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))
    kept = near_dedup.keep_one(docs)
    assert kept.count() == len(want) and kept.columns == docs.columns
    assert near_dedup.near_duplicates(documents([])).count() == 0


def test_document_frequencies_are_exact(spark, documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHARD", 1 << 14)
    rng = random.Random(2)
    shared = [words(rng, 30) for _ in range(4)]
    rows = [(i, " ".join(words(rng, 3_000) + shared[i % 4] + shared[i % 3])) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(900, 903)] + [(999, None), (998, "")]
    found = [near_dedup.shingles(t or "") for _, t in rows]
    df = collections.Counter(h for hashes, _ in found for h in hashes.tolist())
    assert len(df) > 400_000  # many would meet in a table of 2^21 buckets
    idf = near_dedup.inverse_frequencies(common.text_rows(documents(rows)))
    n = len(rows)
    for hashes, counts in found:
        want = counts * (1 + np.log((1 + n) / (1 + np.array([df[h] for h in hashes.tolist()]))) / np.log(2 + n))
        assert np.allclose(near_dedup.weights(hashes, counts, idf), want, rtol=1e-6)


def test_no_pair_at_the_threshold_is_left_out():
    rng = random.Random(11)
    vocabulary, texts = words(rng, 3_000), []
    for n in (1, 3, 40, 400, 3_000):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for edits in (0, 1, n // 90, n // 50, n // 10, n):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(n)] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    texts += ["word " * 200_000, "word " * 170_000, "word " * 120_000]
    vectors = [(h, c * (1 + (h % np.uint64(97)).astype(float) / 97)) for h, c in map(near_dedup.shingles, texts)]
    samples = [bytes(8 * near_dedup.BANDS) + near_dedup.summed(*v) for v in vectors]
    n, names = len(texts), [b"%016d" % i for i in range(len(texts))]
    rows = pa.table({"node": names * 2, "label": names * 2, "failed": [True] * n + [False] * n, "samples": samples * 2})
    found = near_dedup._open_pairs(0, rows, 0.8)
    opened = set(zip(found["node"].to_pylist(), found["head"].to_pylist(), strict=True))
    for i in range(n):
        for j in range(n):
            if i != j and near_dedup.similarity(vectors[i], vectors[j]) >= 0.8:
                assert (names[i], names[j]) in opened
    assert len(opened) < n * (n - 1) / 4


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert found == {x: root(x) for x in parent}


# --- fingerprints ---


def plain_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        t, follow = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + follow[:half]).encode()).hexdigest()))
    return sorted(out)


def test_fingerprints(spark, documents, awkward, monkeypatch):
    rng = random.Random(11)
    rows = awkward + [(20 + i, " ".join(words(rng, 80))) for i in range(120)]
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 10)
    found = simhash.edited_fingerprints(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == plain_next(rows)
    assert len({(r.fp_a, r.fp_b) for r in found if r.doc_id in (1, 2)}) == 1 and len({(r.fp_a, r.fp_b) for r in found if r.doc_id in (3, 4)}) == 1
    assert simhash.edited_fingerprints(documents([])).count() == 0
    near = [1 - (bin((r.fp_a ^ r.ed_a) % 2**64).count("1") + bin((r.fp_b ^ r.ed_b) % 2**64).count("1")) / 128 for r in found if (r.doc_id or 0) >= 20]
    far = [1 - (bin((r.fp_a ^ r.next_a) % 2**64).count("1") + bin((r.fp_b ^ r.next_b) % 2**64).count("1")) / 128 for r in found if (r.doc_id or 0) >= 20]
    assert np.mean(near) > 0.62 and abs(np.mean(far) - 0.5) < 0.05


def test_votes_against_counting(spark):
    text = " ".join(words(random.Random(2), 20_000))
    rows = spark.createDataFrame([(1, text)], "k long, text string")
    found = simhash.fingerprints(rows).first()
    terms = simhash._terms(rows, "text").select("weight", "a", "b").collect()
    for side in "ab":
        want = sum(1 << bit for bit in range(64) if sum(t.weight * (1 if (t[side] >> bit) & 1 else -1) for t in terms) > 0)
        assert found[f"fp_{side}"] % 2**64 == want


@pytest.mark.parametrize(("radius", "blocks"), [(3, 5), (0, 1), (6, 8)])
def test_search_against_all_pairs(spark, radius, blocks):
    rng = random.Random(13)
    fps = [rng.getrandbits(128) for _ in range(30)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(128), rng.randint(1, 9))) for f in fps for _ in range(4)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    df = spark.createDataFrame([(signed(f % 2**64), signed(f >> 64)) for f in fps], "fp_a long, fp_b long")
    found = {(r.q_a, r.q_b, r.fp_a, r.fp_b) for r in simhash.within(df.limit(60), df, radius, blocks).collect()}
    rows = [(r.fp_a, r.fp_b) for r in df.collect()]
    want = {(*q, *p) for q in rows[:60] for p in rows if sum(bin((x ^ y) % 2**64).count("1") for x, y in zip(q, p, strict=True)) <= radius}
    assert found == want


# --- sharding ---


def test_shards(spark, documents, awkward):
    rng = random.Random(17)
    rows = awkward + [(100 + i, " ".join(words(rng, rng.randint(1, 50)))) for i in range(300)] + [(900 + i, "hot text " * 3) for i in range(150)]
    found = sharding.shard_documents(documents(rows), 4).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    by, shard_of = collections.defaultdict(list), collections.defaultdict(set)
    for r in found:
        by[r.shard].append(r)
        shard_of[r.digest].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    assert sum(r["size"] for r in found) == sum(len((t or "").encode()) + 1 for _, t in rows)
    assert sharding.shard_documents(documents([]), 4).count() == 0


@given(st.lists(st.integers(1, 1000), max_size=60), st.integers(1, 6))
def test_longest_first_bound(sizes, shards):
    dealt = sharding.longest_first(sizes, shards)
    loads = [sum(s for s, d in zip(sizes, dealt, strict=True) if d == k) for k in range(shards)]
    best = max(max(sizes, default=0), -(-sum(sizes) // shards))
    assert max(loads) <= best * 4 / 3 + 1 + max(sizes, default=0) * (len(sizes) > 0) / 3
    assert F is not None
