"""The op queries themselves over the smallest tables: columns and types, SQL, and plain versions of what SQL cannot say."""

import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import near_dedup, registry, toxicity
from corpusloom.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")

COLUMNS = {
    "op1_packing": "doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,sequence_id:bigint,offset:bigint",
    "op2_byte_bpe": "doc_id:bigint,n_tokens:bigint,ids_sha256:string,decoded_sha256:string",
    "op3_toxicity": "doc_id:bigint,held_out:boolean,score:double,predicted:int",
    "op4_near_dedup": "doc_id:bigint,class_id:bigint,links:bigint",
    "op5_sharding": "doc_id:bigint,size:bigint,text_crc32:bigint,law:string,shard:int,slot:bigint,grown_shard:int",
    "op6_chat_formatting": "conv_id:bigint,n_turns:bigint,turns_sha256:string,loss_chars:bigint,loss_sha256:string,formatted_chars:bigint,n_examples:bigint",
    "op7_fingerprints": "doc_id:bigint,n_chars:bigint,edited_sha256:string,fingerprint:string,edited_fingerprint:string,near_edited:double,near_next:double,near_docs:bigint",
    "op8_line_dedup": "doc_id:bigint,n_lines:bigint,n_dropped:bigint,kept_sha256:string",
    "op9_exact_dedup": "doc_id:bigint,keep_id:bigint,group_size:bigint,kept:boolean,text_sha256:string",
    "op10_lm_scores": "doc_id:bigint,held_out:boolean,n_tokens:bigint,n_known:bigint,train_tokens:bigint,base_score:double,score:double",
}


@pytest.fixture(scope="module")
def result(spark):
    cache = {}

    def get(name):
        if name not in cache:
            df = registry.QUERIES[name](spark, SF)
            cache[name] = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema), df.collect()
        return cache[name]

    return get


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_every_query_is_listed():
    assert set(registry.QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(result, texts, name):
    columns, rows = result(name)
    assert columns == COLUMNS[name]
    if name not in ("op1_packing", "op6_chat_formatting"):
        assert sorted(r.doc_id for r in rows) == sorted(texts)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(result, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    columns = [c.split(":")[0] for c in COLUMNS[name].split(",")]
    want = con.sql(registry.ORACLES[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(map(repr, (tuple(r) for r in result(name)[1]))) == sorted(map(repr, want))


def test_packing_by_the_plain_call(result, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in result("op1_packing")[1]:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text in texts.items():
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))] and sum(r.length for r in pieces) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces) and all(r.length == 2048 for r in pieces[1:])
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))] and sum(r.length for r in parts) <= 2048
    total = sum(r.length for r in result("op1_packing")[1])
    assert len(by_sequence) <= math.ceil(total / 2048) + 3


def test_bpe_by_the_library(result, texts):
    import tiktoken

    from corpusloom.llm import byte_bpe

    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in result("op2_byte_bpe")[1]:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def plain_windows(net, text):
    """The highest logit of a text's windows, each word and step by itself."""
    words, w, h = toxicity.words_of(text), net.w, toxicity.HIDDEN
    sign = lambda x: x / (1 + np.abs(x))
    best = -math.inf
    for at in range(0, max(1, len(words) - toxicity.STRIDE), toxicity.STRIDE):
        vectors = [net.vectors([x])[0] for x in words[at : at + toxicity.WINDOW]]
        states = []
        for d in "fb":
            state, run = np.zeros(h), {}
            order = range(len(vectors)) if d == "f" else range(len(vectors) - 1, -1, -1)
            for t in order:
                x = vectors[t] @ w[f"x{d}"] + w[f"bias{d}"]
                gate = sign(x[: 2 * h] + state @ w[f"zr{d}"])
                z, r = 0.5 + 0.5 * gate[:h], 0.5 + 0.5 * gate[h:]
                state = state + z * (sign(x[2 * h :] + (r * state) @ w[f"c{d}"]) - state)
                run[t] = state
            states.append(run)
        both = np.array([np.concatenate([states[0][t], states[1][t]]) for t in range(len(vectors))])
        e = np.exp(4 * (sign(both @ w["att"] + w["att_bias"]) @ w["att_v"]))
        best = max(best, float((e / e.sum()) @ both @ w["out"] + w["out_bias"][0]))
    return best


def test_toxicity_by_a_plain_pass(spark, result, texts):
    docs = table(spark, SF, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    weights = toxicity.fit(docs, table(spark, SF, "labels"))
    rows = {r.doc_id: r for r in result("op3_toxicity")[1]}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    if weights is None:
        assert all(r.score == 0 for r in rows.values())
        return
    net = toxicity.Network.load(weights)
    a, b = net.scale
    for doc_id in sorted(texts)[:12]:
        assert abs(rows[doc_id].score - 1 / (1 + math.exp(-max(-30, min(30, a * plain_windows(net, texts[doc_id]) + b))))) < 1e-3


def test_very_long_texts_score_as_their_runs(monkeypatch):
    scorer = toxicity.Scorer(toxicity.Network(3))
    texts = [" ".join(f"w{k * j % 97}" for k in range(700)) for j in (3, 5)]
    whole = scorer(texts)
    monkeypatch.setattr(toxicity, "RUN_WORDS", 64)
    assert np.allclose(scorer(texts), whole, atol=1e-6)


def test_sharding_by_linear_search(result, texts):
    groups = collections.Counter()
    for text in texts.values():
        groups[hashlib.sha256(text.encode()).digest()] += len(text.encode()) + 1
    least = sum(groups.values()) // 65_536  # every larger group is a unit of its own
    load, shard_of = [0] * 16, {}
    for size, digest in sorted((-n, d) for d, n in groups.items() if n > least):
        place = min(range(16), key=lambda s: (load[s], s))
        shard_of[digest], load[place] = place, load[place] - size
    rows = result("op5_sharding")[1]
    shards = collections.defaultdict(set)
    for r in rows:
        digest = hashlib.sha256(texts[r.doc_id].encode()).digest()
        shards[digest].add(r.shard)
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None
        assert digest not in shard_of or shard_of[digest] == r.shard
    assert all(len(s) == 1 for s in shards.values())
    sums, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) - min(sums.values()) <= max(groups.values())


def plain_print(text):
    words = re.split(r"[ \t\n\x0b\f\r]+", text.lower())
    chain = lambda parts: [h := 42, *(h := xxhash.xxh64_intdigest(p, h) for p in parts)][-1]
    votes, total = [0] * 128, 0
    for word, after in zip(words, [*words[1:], None], strict=True):
        weight = min(4, 1 + (len(word) >> 2))
        own, following = word.encode(), [] if after is None else [after.encode()]
        bits = chain([own, *following]) << 64 | chain([(7).to_bytes(4, "little"), *following, own])
        total += weight
        for k in range(128):
            votes[k] += weight * (bits >> k & 1)
    return sum(1 << k for k in range(128) if 2 * votes[k] > total)


def test_fingerprints_by_single_votes(result, texts):
    order = sorted(texts, reverse=True)
    prints = {i: plain_print(t) for i, t in texts.items()}
    like = lambda a, b: 1 - (a ^ b).bit_count() / 128
    rows = {r.doc_id: r for r in result("op7_fingerprints")[1]}
    for at, i in enumerate(order):
        text, following = texts[i], order[(at + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[following][:half]
        other = plain_print(edited)
        near = sum((prints[i] ^ p).bit_count() <= 3 for p in prints.values()) if i % 50 == 0 else None
        r = rows[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[i]:032x}", f"{other:032x}")
        assert abs(r.near_edited - like(prints[i], other)) < 1e-12 and abs(r.near_next - like(prints[i], prints[following])) < 1e-12 and r.near_docs == near


def all_pairs(texts, least=near_dedup.SIMILARITY):
    """Every pair of different texts of that similarity, by an index of all shingles."""
    distinct = sorted(set(texts))
    shingled = [near_dedup.shingles(t) for t in distinct]
    times = collections.Counter(texts)
    df = collections.Counter()
    for t, (hashes, _) in zip(distinct, shingled, strict=True):
        for x in hashes.tolist():
            df[x] += times[t]
    vectors = [(h, c * near_dedup.inverse(np.array([df[x] for x in h.tolist()]), len(texts))) for h, c in shingled]
    holders = collections.defaultdict(list)
    found = []
    for k, (hashes, _) in enumerate(vectors):
        shared = collections.Counter(j for x in hashes.tolist() for j in holders[x])
        found += [(distinct[j], distinct[k]) for j, n in shared.items() if n * 4 >= len(hashes) and near_dedup.similarity(vectors[j], vectors[k]) >= least]
        for x in hashes.tolist():
            holders[x].append(k)
    return found


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_recall_of_near_duplicates(spark, folder):
    at = f"/root/testdata/{folder}"
    text_of = {r.doc_id: r.text or "" for r in table(spark, at, "documents").select("doc_id", "text").collect()}
    class_of, links = {}, {}
    for r in registry.QUERIES["op4_near_dedup"](spark, at).collect():
        text = text_of[r.doc_id]
        assert class_of.setdefault(text, r.class_id) == r.class_id
        links[text] = r.links
    pairs = all_pairs(list(text_of.values()))
    assert pairs
    together = sum(class_of[a] == class_of[b] for a, b in pairs)
    assert together >= 0.99 * len(pairs)
    # No class holds texts that no chain of similar pairs joins.
    parent = {t: t for t in class_of}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    by_class = collections.defaultdict(set)
    for text, name in class_of.items():
        by_class[name].add(root(text))
    assert all(len(x) == 1 for x in by_class.values())
    partners = collections.Counter(t for p in pairs for t in p)
    assert all(links[t] <= partners[t] for t in class_of) and all((links[t] > 0) == (partners[t] > 0) for t in class_of)


def test_scores_are_better_than_the_base(result):
    rows = result("op10_lm_scores")[1]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.n_known <= r.n_tokens for r in rows)
    assert sum(r.score for r in rows if not r.held_out) > sum(r.base_score for r in rows if not r.held_out)


# --- empty tables, clashing columns ---------------------------------------------------------


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables like the smallest ones, empty or with further columns whose names the operators use themselves."""

    def make(empty):
        folder = str(tmp_path_factory.mktemp("empty" if empty else "clash"))
        for name in ("documents", "labels", "conversations"):
            rows = table(spark, SF, name)
            rows = rows.limit(0) if empty else rows.limit(40)
            for extra in () if empty else ("row", "digest", "node", "score", "bucket", "unit", "key_id", "first", "text_hash", "kind", "segment", "example", "shard", "words", "group", "label", "head"):
                rows = rows.withColumn(extra, F.lit("clash"))
            rows.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return {empty: make(empty) for empty in (True, False)}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_empty_tables(spark, odd, name):
    df = registry.QUERIES[name](spark, odd[True])
    assert ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema) == COLUMNS[name]
    assert df.count() == (1 if name == "op6_chat_formatting" else 0)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_clashing_columns(spark, odd, name):
    df = registry.QUERIES[name](spark, odd[False])
    assert ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema) == COLUMNS[name] and df.count() >= 10


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_odd_tables(spark, odd, empty):
    import corpus_pipeline

    docs = table(spark, odd[empty], "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, odd[empty])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
        assert out.count() == 0 if empty else out.count() > 0
