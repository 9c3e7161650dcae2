"""Packing, byte-level BPE, chat formatting, toxicity, language model and pipeline against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, chat, ngram_lm, packing, toxicity

BPE, FAST = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- packing ---


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=150))
def test_rule_against_plain(lengths):
    size, ordered = 64, sorted(lengths, reverse=True)
    where, offset, levels = packing.sum_of_squares(np.array(ordered, np.int64), size)
    open_gaps: list[int] = []  # gaps by sequence

    def squares(gaps):
        return sum(v * v for g, v in collections.Counter(gaps).items() if g > 0)

    for n in ordered:
        fits = [k for k, g in enumerate(open_gaps) if g >= n]
        if fits:
            best = min(squares([g - n if j == k else g for j, g in enumerate(open_gaps)]) for k in fits)
            k = next(k for k in fits if squares([g - n if j == k else g for j, g in enumerate(open_gaps)]) == best and True)
            open_gaps[k] -= n
        else:
            open_gaps.append(size - n)
    assert len(levels) == len(open_gaps) or abs(len(levels) - len(open_gaps)) <= 1  # ties may fall otherwise
    filled = collections.Counter()
    for s, o, n in sorted(zip(where.tolist(), offset.tolist(), ordered, strict=True)):
        assert o == filled[s]
        filled[s] += n
    assert all(v <= size for v in filled.values())


@given(st.integers(1, 5000), st.integers(16, 600))
def test_cuts(length, size):
    found = packing.cuts(length, size)
    assert [s for s, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))] and sum(n for _, n in found) == length
    assert all(n == size for _, n in found[1:]) and 0 < found[0][1] <= size


def check_packing(rows, found, size=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    pieces = collections.Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (start, n) in enumerate(packing.cuts(len(ids), size)):
            pieces[str(i), k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    assert collections.Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == pieces
    by = collections.defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(by), sum(r.length for r in found)


def test_packing(spark, documents, awkward, monkeypatch):
    rng = random.Random(1)
    rows = awkward + [(100 + i, "some words of text " * rng.randint(1, 300)) for i in range(200)]
    n, total = check_packing(rows, packing.pack_documents(documents(rows), BPE, FAST).collect())
    assert n <= -(-total // 2048) + 3
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    n, total = check_packing(rows, packing.pack_documents(documents(rows), BPE, FAST).collect())
    assert n <= -(-total // 2048) * 1.1 + 3
    assert packing.pack_documents(documents([]), BPE, FAST).count() == 0


def test_loss_by_groups(spark, monkeypatch):
    """A group loses a few sequences, so the share that many groups lose depends on their size alone."""
    lengths = np.random.default_rng(4).integers(1, 2049, 4_000)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "unit long, length long").cache()
    bound = -(-int(lengths.sum()) // 2048)
    used = {}
    for groups in (1, 20, 200):
        monkeypatch.setattr(packing, "GROUP_ROWS", 4_000 // groups)
        placed = packing.pack_pieces(pieces)
        assert placed.count() == 4_000
        used[groups] = placed.select("sequence_id").distinct().count()
    assert used[1] <= bound * 1.012 and used[20] <= bound * 1.06 and used[200] <= bound * 1.12, (bound, used)


def test_special_token_s_string():
    assert list(packing._encoder(BPE, FAST)("a<|endoftext|>b")) == [64, 50256, 65] == list(packing._encoder(BPE, None)("a<|endoftext|>b"))
    assert 50256 not in packing._encoder(BPE, FAST, True)("a<|endoftext|>b")


def test_fast_path_agrees_below_its_bound():
    slow, fast = packing._encoder(BPE, None), packing._encoder(BPE, FAST)
    for c in map(chr, range(0x370)):
        for text in (c, f"a{c}b", f" {c} {c}1", f"x{c}{c}  y", f"{c}\n\n z<|endoftext|>{c}"):
            assert list(slow(text)) == list(fast(text)), repr(text)


# --- byte-level BPE ---


def reference():
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(RANKS), special_tokens={})


def test_bpe_against_library(spark, documents, awkward, monkeypatch):
    rng = random.Random(3)
    rows = awkward + [(100 + i, "".join(rng.choice("abc ABC éüß1 \n.,漢🙂'") for _ in range(rng.randint(0, 200)))) for i in range(150)]
    plain = reference()
    rows += [(i + 1000, w) for i, w in enumerate(("y" * 1_024, "y" * 1_025, "<|endoftext|>", "".join(rng.choice("etaoinshrdlu") for _ in range(900))))]
    want = sorted((str(i), plain.encode_ordinary(t or "")) for i, t in rows)
    for chunk, known in ((1 << 20, 1 << 20), (300, 50)):
        monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(byte_bpe, "KNOWN_WORDS", known)
        coded = byte_bpe.encode(documents(rows), RANKS, public_tokenizers.PATTERN)
        assert sorted((str(r.doc_id), list(r.ids)) for r in coded.collect()) == want
    assert collections.Counter((str(r.doc_id), bytes(r["bytes"])) for r in byte_bpe.decode(coded, RANKS).collect()) == collections.Counter((str(i), (t or "").encode()) for i, t in rows)
    for r in byte_bpe.round_trip(documents(rows), RANKS, public_tokenizers.PATTERN).collect():
        ids = next(x for i, x in want if i == str(r.doc_id))
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert byte_bpe.encode(documents([]), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40) | st.text("aeinrst hé", min_size=1, max_size=40).map(str.encode), min_size=1, max_size=6))
def test_settled_pairs_are_in_the_library_s_result(words):
    """Every word starts as a cut of its bytes that the library's pieces only join, never cut."""
    plain, pieces = reference(), byte_bpe.list_of_pieces(RANKS)
    elements, ends = byte_bpe.initial(words, RANKS)
    for word, a, b in zip(words, ends, ends[1:], strict=False):
        ids = (elements[a:b] & byte_bpe.END).tolist()
        assert ids[0] == ids[-1] == byte_bpe.END and b"".join(pieces[i] for i in ids[1:-1]) == word
        starts = lambda own: set(np.cumsum([0, *(len(pieces[i]) for i in own)]).tolist())
        whole = [byte_bpe.ranks(RANKS)[word]] if word in byte_bpe.ranks(RANKS) else byte_bpe.merged_by_heap(word, RANKS)
        assert starts(whole) <= starts(ids[1:-1])
        try:
            text = word.decode()
        except UnicodeDecodeError:
            continue
        if re.fullmatch(r"[a-zé]+", text):
            assert plain.encode_ordinary(text) == whole


# --- chat ---


@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", " ", "a", "\n", "<", "["]), max_size=12).map("".join), st.sampled_from(["user", "assistant", "system", "", "to<s>ol", " x "]))
def test_turns_round_trip(text, role):
    segment, a, b = chat.formatted(role, text)
    assert chat.parsed(segment) == (role, text) and chat.unescaped(segment[a:b]) == text
    body = chat.escaped(text)
    assert not re.search(r"(?<!\\)(?:" + "|".join(map(re.escape, chat.CONTROL)) + ")", body)


def test_examples(spark):
    turns = [(1, 0, "system", "be </s> kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "[INST] hello"), (1, 3, "user", None), (1, 4, "assistant", "bye"), (2, 0, "user", "only"), (None, 0, None, "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.segments(df)
    found = chat.examples(made)
    assert sorted((r.conv_id, r.example) for r in found.collect()) == [(1, 0), (1, 1), (3, 0), (3, 1)]
    texts = {(r.conv_id, r.example): r for r in chat.example_texts(made, found).collect()}
    r = texts[1, 1]
    assert r.text.startswith("<s><<ROLE>> system <</ROLE>> be \\</s> kind </s>") and chat.unescaped(r.text[r.loss_start : r.loss_end]) == "bye" and r.text.endswith("bye </s>")
    assert r.text.startswith(texts[1, 0].text)
    by = {d.conv_id: d for d in chat.digests(made, found).collect()}
    ordered = sorted((t for t in turns if t[0] == 1), key=lambda t: t[1])
    assert by[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t or ''}\n" for _, _, r, t in ordered).encode()).hexdigest()
    assert by[1].loss_sha256 == hashlib.sha256(b"[INST] hellobye").hexdigest() and by[1].loss_chars == 15
    assert by[3].loss_sha256 == hashlib.sha256(b"ab").hexdigest() and by[None].n_turns == 1 and by[2].loss_chars == 0
    assert chat.segments(df.limit(0)).count() == 0 and chat.digests(made.limit(0), found.limit(0)).count() == 0
    for wrong in ({"reply": F.lit("bye!")}, {"context_sha256": F.lit("0" * 64)}, {"loss_start": F.col("loss_start") + 1}):
        with pytest.raises(Exception, match="does not follow its context"):
            chat.digests(made, found.withColumns(wrong)).collect()
    long = spark.range(3_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("ab </s> "), 200).alias("text"), F.lit(7).alias("segment"), F.lit("x").alias("seq"))
    made = chat.segments(long)
    row = chat.digests(made, chat.examples(made)).first()
    assert (row.n_turns, row.n_examples, row.loss_chars) == (3_000, 1_500, 1_500 * 1_600)


# --- toxicity ---


def test_gradient():
    net, rng = toxicity.Network(1), np.random.default_rng(0)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = {d: rng.standard_normal((5, 3, 3 * toxicity.HIDDEN)) for d in "fb"}
    mask = np.ones((5, 3))
    mask[3:, 1] = 0
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        z = net.logits(x, mask)
        return float((weight * (np.logaddexp(0, z) - y * z)).mean())

    grads, d_x = net.gradient(x, mask, y, weight)
    for name, g in grads.items():
        w, at = net.w[name], tuple(rng.integers(0, s) for s in net.w[name].shape)
        old = w[at]
        w[at] = old + 1e-3
        up = loss()
        w[at] = old - 1e-3
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 2e-3 * max(1, abs(g[at])) + 1e-4, name
    for d in "fb":
        at = (2, 0, 4)
        old = x[d][at]
        x[d][at] = old + 1e-3
        up = loss()
        x[d][at] = old - 1e-3
        down = loss()
        x[d][at] = old
        assert abs((up - down) / 2e-3 - d_x[d][at]) < 1e-3


def test_windows_cover_and_overlap():
    for n in (1, 15, 16, 17, 32, 33, 100):
        spans = [(a, min(n, a + toxicity.WINDOW)) for a in toxicity.starts(n)]
        assert {k for a, b in spans for k in range(a, b)} == set(range(n))
        assert all(a2 < b1 for (_, b1), (a2, _) in zip(spans, spans[1:], strict=False))


def test_toxicity_learns(spark, documents, awkward):
    rng = random.Random(5)
    common = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(common) for _ in range(rng.randint(5, 120))]
        toxic = int(i % 4 == 0)
        for _ in range(2 * toxic):
            text[rng.randrange(len(text))] = rng.choice(["vilest", "vile" + rng.choice(common), "grotted"])
        rows.append((1000 + i, " ".join(text)))
        labels.append((1000 + i, 1, toxic))
    table = spark.createDataFrame([*labels, (None, 1, 1), (1, None, None), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(rows + awkward)
    found = toxicity.toxicity(docs, table).collect()
    assert len(found) == len(rows) + len(awkward) and all(0 <= r.score <= 1 for r in found)
    truth = {i: t for i, _, t in labels}
    held = [(r.score, truth[r.doc_id]) for r in found if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x > y]
    assert np.mean(pairs) > 0.95
    kept = toxicity.keep_clean(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.3 for r in found)
    assert {r.score for r in toxicity.toxicity(docs, table.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(documents([]), table).count() == 0


def test_long_runs_are_read_whole():
    for unit in ("漢字かな", "snake_case_", "ทดสอบ", "é"):
        run = unit * 400
        raw, pieces = run.encode(), toxicity.words_of(run + "毒_end")
        assert all(len(p.encode()) <= toxicity.PIECE for p in pieces)
        whole = raw + "毒_end".encode()
        found = {p.encode()[k : k + 5] for p in pieces for k in range(len(p.encode()) - 4)}
        assert {whole[k : k + 5] for k in range(len(whole) - 4)} <= found
    scorer = toxicity.Scorer(toxicity.Network(3))
    clean, tail = scorer(["漢字" * 60, "漢字" * 60 + "毒" * 12]).tolist()
    assert clean != tail
    assert toxicity.words_of("a " + "b" * 120) == ["a", "b" * 120]


# --- language model ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40 - 1), max_size=200, unique=True), st.lists(st.integers(0, 2**40 - 1), max_size=50))
def test_elias_fano(values, asked):
    v = np.sort(np.array(values, np.uint64))
    sequence, q = ngram_lm.EliasFano.of(v, 1 << 40), np.array(values + asked, np.uint64)
    place = {x: i for i, x in enumerate(v.tolist())}
    assert sequence.find(q).tolist() == [place.get(x, -1) for x in q.tolist()]
    assert sequence.lows(np.arange(len(v))).tolist() == [x % (1 << sequence.low_bits) for x in v.tolist()]
    assert sequence.get(np.arange(len(v))).tolist() == v.tolist()


def test_elias_fano_of_many_numbers_with_one_high_part(monkeypatch):
    v = np.append(np.arange(0, 60_000, 3, dtype=np.uint64), np.uint64((1 << 40) - 1))
    sequence, seen = ngram_lm.EliasFano.of(v, 1 << 40), []
    own = ngram_lm.EliasFano.lows
    monkeypatch.setattr(ngram_lm.EliasFano, "lows", lambda self, at: seen.append(len(at)) or own(self, at))
    assert sequence.find(np.arange(60_000, dtype=np.uint64)).tolist() == [i // 3 if i % 3 == 0 else -1 for i in range(60_000)]
    assert len(seen) <= 20 and sum(seen) <= 20 * 60_000  # halving, not one place after the other


def test_trie_against_dict():
    rng = np.random.default_rng(2)
    bits = np.uint64(ngram_lm.WORD_BITS)
    pairs = np.unique(rng.integers(0, 50, 3000, dtype=np.uint64) << bits | rng.integers(0, 400, 3000, dtype=np.uint64))
    counts = rng.integers(1, 1000, len(pairs))
    trie = ngram_lm.Trie(pairs, counts, {7: 10**7})
    asked = np.unique(np.concatenate([pairs[::2], pairs[:500] + np.uint64(1), np.array([99], np.uint64) << bits]))
    found, known = trie.find(asked), dict(zip(pairs.tolist(), counts.tolist(), strict=True))
    total = collections.Counter()
    for p, n in known.items():
        total[p >> ngram_lm.WORD_BITS] += n
    total[7] = 10**7
    assert np.diff(trie.pointers.get(np.arange(trie.contexts.n + 1)).astype(np.int64)).tolist() == [n for _, n in sorted(collections.Counter(p >> ngram_lm.WORD_BITS for p in known).items())]
    trie.close()
    for p, code in zip(asked.tolist(), found.tolist(), strict=True):
        assert (code > 0) == (p in known)
        if code:
            assert abs(ngram_lm.restored(np.array([code - 1]))[0] * (total[p >> ngram_lm.WORD_BITS] + ngram_lm.MU) / known[p] - 1) < 1e-3


@pytest.mark.parametrize(("chunk", "shard"), [(1 << 22, 1 << 24), (400, 900)])
def test_scores_against_counting(spark, documents, awkward, monkeypatch, chunk, shard):
    rng = random.Random(9)
    rows = awkward + [(100 + i, " ".join(rng.choice(["a", "B", "cc", "Dd", "e" + str(rng.randrange(9))]) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    monkeypatch.setattr(ngram_lm, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(ngram_lm, "SHARD_CHARS", shard)
    found = ngram_lm.scores(documents(rows)).collect()
    words = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words[str(i)] = [w for w in re.split("[\x20\x09-\x0D]+", low) if w] + ["\n"]
    single, pair = collections.Counter(), collections.Counter()
    for i, _ in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            own = words[str(i)]
            single.update(own)
            pair.update(zip(["\n", *own], own, strict=False))
    n, v = sum(single.values()), len(single)
    assert len(found) == len(rows)
    for r in found:
        own = words[str(r.doc_id)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(single[w] > 0 for w in own), n)
        assert abs(r.base_score - sum(math.log10((single[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
        want = sum(math.log10((pair[c, w] + ngram_lm.MU * (single[w] + 1) / (n + v + 1)) / (single[c] + ngram_lm.MU)) for c, w in zip(["\n", *own], own, strict=False))
        assert abs(r.score - want) < 1e-3 * len(own)
    assert ngram_lm.scores(documents([])).count() == 0


# --- pipeline ---


def test_pipeline_stages(spark, documents, awkward, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    common = ["w" + str(i) for i in range(300)]
    rows, labels = list(awkward), []
    for i in range(300):
        text = [rng.choice(common) for _ in range(60)]
        if i % 3 == 0:
            text[5] = text[30] = "vilest"
        rows.append((1000 + i, " ".join(text)))
        labels.append((1000 + i, 1, int(i % 3 == 0)))
    clean = next(t for i, t in rows if i == 1001)
    rows += [(5000, clean), (5001, clean.replace(" ", "  ")), (5002, clean + " extra")]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    left = {r.doc_id for r in docs.collect()}
    assert 1001 in left and not left & {5000, 5001, 5002} and len(left & {1000 + i for i in range(0, 300, 3)}) < 20 and len(left & {1000 + i for i in range(300) if i % 3}) > 180
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in found.select("doc_id").distinct().collect()} == left
