"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of an embedding of the word and embeddings of its character n-grams
(3 to 5 bytes, with marks at both ends), all hashed to fixed tables. A forward and a backward
gated recurrent layer read a window of ``WINDOW`` words; attention pools their states; a logistic
unit scores the window. The gates use softsign functions, which numpy evaluates quickly.

A document's score is the largest over all windows of its whole text, which start every ``STRIDE``
words and so overlap, put on the scale of probabilities by a logistic fit. A run of word characters
of more than ``PIECE`` bytes enters as several words, cut between code points; neighbours overlap
by all but one byte of the longest n-gram at least, so no n-gram of the run is lost.

Training is by gradient descent in numpy, in one task, on a bounded sample: at most
``POSITIVES`` and ``NEGATIVES`` labelled documents, taken by a hash of their ids. The first pass
takes every window with its document's label, those of a document of more than ``FIRST_PASS`` windows with
so much less weight each that no document weighs more than ``FIRST_PASS`` windows; later passes take the window that scores highest
so far (and a random one of clean documents). A pass takes ``STEPS`` steps at least, going over a
small sample several times. Everything is seeded: equal samples give equal weights.

Defined results: a null or empty text is scored like one empty word; rows that repeat an id are
scored each; without labels of both classes every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, text_rows

WINDOW, STRIDE, HIDDEN, DIM, ATTENTION = 32, 16, 8, 12, 8
WORD_ROWS, CHAR_ROWS, NGRAMS = 1 << 14, 1 << 16, (3, 4, 5)
POSITIVES, NEGATIVES, PASSES, BATCH, STEPS, FIRST_PASS = 2_000, 3_000, 5, 128, 100, 8
KNOWN_WORDS, BLOCK, PIECE, FIRST_STEPS, BYTES, STEP = 150_000, 2_048, 120, 320, 2 << 20, 512
RUN_WORDS = 1 << 17  # a multiple of STRIDE, so that runs have the windows of the whole
_WORD = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text; one empty word if there are none."""
    words = _WORD(text.lower())
    if any(4 * len(w) > PIECE for w in words):
        words = [piece for w in words for piece in (_pieces(w) if 4 * len(w) > PIECE else [w])]
    return words or [""]


def _pieces(word: str) -> list[str]:
    """The whole word in overlapping pieces of at most ``PIECE`` bytes."""
    raw = word.encode("utf-8", "surrogatepass")
    out, at = [], 0
    while len(raw) - at > PIECE:
        end = at + PIECE
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end].decode("utf-8", "surrogatepass"))
        at = end - max(NGRAMS) + 1
        while raw[at] & 0xC0 == 0x80:
            at -= 1
    return [*out, raw[at:].decode("utf-8", "surrogatepass")]


def starts(n: int) -> range:
    """Where the windows over n words start: every word is in one, all but the ends in two."""
    return range(0, max(1, n - STRIDE), STRIDE)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, rows): of each word, its row of the word table, then rows of the character table."""
    raw = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = n.cumsum()
    owner, left = np.repeat(np.arange(len(raw)), n), np.repeat(ends, n) - np.arange(len(data))
    owners, rows = [], []
    running = np.zeros(len(data), np.uint64)
    for k in range(max(NGRAMS)):
        fit_in = max(0, len(data) - k)
        running[:fit_in] = running[:fit_in] * np.uint64(0x100000001B3) + data[k:]
        if k + 1 in NGRAMS:
            whole = left > k
            mixed = running[whole] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            owners.append(owner[whole])
            rows.append((mixed >> np.uint64(48)).astype(np.int64) % CHAR_ROWS + WORD_ROWS)
    whole_word = np.zeros(len(raw), np.uint64)
    powers = np.cumprod(np.full(int(n.max()), 0x100000001B3, np.uint64))
    np.add.at(whole_word, owner, data * powers[np.repeat(n, n) - left])
    owners.append(np.arange(len(raw)))
    rows.append((whole_word * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)).astype(np.int64) % WORD_ROWS)
    owners, rows = np.concatenate(owners), np.concatenate(rows)
    order = np.argsort(owners, kind="stable")
    return np.searchsorted(owners[order], np.arange(len(raw) + 1)), rows[order]


def _softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """The derivative of softsign where it has the value y."""
    return (1 - np.abs(y)) ** 2


class Network:
    """The weights, the score of windows, and the gradient."""

    def __init__(self, seed: int = 7, weights: dict[str, np.ndarray] | None = None):
        rng = np.random.default_rng(seed)
        normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        h = HIDDEN
        self.table = (rng.standard_normal((WORD_ROWS + CHAR_ROWS, DIM)) * 0.1).astype(np.float32)
        self.w = {f"{k}{d}": v for d in "fb" for k, v in {"x": normal(DIM, 3 * h), "bias": np.zeros(3 * h, np.float32), "zr": normal(h, 2 * h), "c": normal(h, h)}.items()}
        self.w |= {"att": normal(2 * h, ATTENTION), "att_bias": np.zeros(ATTENTION, np.float32), "att_v": normal(ATTENTION), "out": normal(2 * h), "out_bias": np.zeros(1, np.float32)}
        self.scale = np.array([1.0, 0.0], np.float32)
        if weights:
            self.table, self.scale = weights.pop("table"), weights.pop("scale")
            self.w = weights

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, table=self.table, scale=self.scale, **self.w)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        with np.load(io.BytesIO(data)) as found:
            return cls(weights={k: found[k] for k in found.files})

    def vectors(self, words: list[str]) -> np.ndarray:
        """The input of each word: the mean of its rows, so that words of any length weigh alike."""
        offsets, rows = features(words)
        return np.add.reduceat(self.table[rows], offsets[:-1], axis=0) / np.sqrt(np.diff(offsets))[:, None].astype(np.float32)

    def projected(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {d: vectors @ self.w[f"x{d}"] + self.w[f"bias{d}"] for d in "fb"}

    def _layer(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States by step of one direction; x is (steps, windows, 3 h)."""
        h, zr, c_w = HIDDEN, self.w[f"zr{d}"], self.w[f"c{d}"]
        steps, n = x.shape[:2]
        state, out = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gate = _softsign(x[t, :, : 2 * h] + state @ zr)
            z, r = 0.5 + 0.5 * gate[:, :h], 0.5 + 0.5 * gate[:, h:]
            reset = r * state
            c = _softsign(x[t, :, 2 * h :] + reset @ c_w)
            new = (state + z * (c - state)) * mask[t][:, None]
            if keep is not None:
                keep.append((t, state, gate, z, r, reset, c))
            out[t] = state = new
        return out

    def logits(self, x: dict[str, np.ndarray], mask: np.ndarray, cache: dict | None = None) -> np.ndarray:
        """One logit for each window; x by direction, mask (steps, windows)."""
        kept = {d: [] if cache is not None else None for d in "fb"}
        states = np.concatenate([self._layer(x[d], mask, d, kept[d]) for d in "fb"], axis=2)
        a = _softsign(states @ self.w["att"] + self.w["att_bias"])
        e = np.exp(4 * (a @ self.w["att_v"])) * mask
        alpha = e / e.sum(axis=0)
        pooled = (alpha[:, :, None] * states).sum(axis=0)
        if cache is not None:
            cache.update(kept=kept, states=states, a=a, alpha=alpha, pooled=pooled)
        return pooled @ self.w["out"] + self.w["out_bias"][0]

    def gradient(self, x: dict[str, np.ndarray], mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Of the mean logistic loss: by weight, and by input x."""
        cache: dict = {}
        logit = self.logits(x, mask, cache)
        states, a, alpha, pooled = cache["states"], cache["a"], cache["alpha"], cache["pooled"]
        g = (weight * (1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        grads = {"out": pooled.T @ g, "out_bias": np.array([g.sum()], np.float32)}
        d_pooled = g[:, None] * self.w["out"]
        d_alpha = (states * d_pooled).sum(axis=2)
        d_e = 4 * alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        d_a = d_e[:, :, None] * self.w["att_v"] * _slope(a)
        grads |= {"att_v": np.tensordot(d_e, a, ([0, 1], [0, 1])), "att": np.tensordot(states, d_a, ([0, 1], [0, 1])), "att_bias": d_a.sum(axis=(0, 1))}
        d_states = alpha[:, :, None] * d_pooled + d_a @ self.w["att"].T
        h, d_x = HIDDEN, {}
        for k, d in enumerate("fb"):
            zr, c_w = self.w[f"zr{d}"], self.w[f"c{d}"]
            own, out = d_states[:, :, k * h : k * h + h], np.empty_like(x[d])
            g_zr, g_c = np.zeros_like(zr), np.zeros_like(c_w)
            back = np.zeros((len(y), h), np.float32)
            for t, state, gate, z, r, reset, c in reversed(cache["kept"][d]):
                d_new = (back + own[t]) * mask[t][:, None]
                d_c = d_new * z * _slope(c)
                d_reset = d_c @ c_w.T
                d_gate = 0.5 * _slope(gate) * np.concatenate([d_new * (c - state), d_reset * state], axis=1)
                out[t] = np.concatenate([d_gate, d_c], axis=1)
                g_c += reset.T @ d_c
                g_zr += state.T @ d_gate
                back = d_new * (1 - z) + d_reset * r + d_gate @ zr.T
            grads |= {f"zr{d}": g_zr, f"c{d}": g_c}
            d_x[d] = out
        return grads, d_x


def _windowed(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(windows of word numbers, document of each); -1 pads the last."""
    rows, owner = [], []
    for i, words in enumerate(texts):
        for at in starts(len(words)):
            part = words[at : at + WINDOW]
            rows.append(part + [-1] * (WINDOW - len(part)))
            owner.append(i)
    return np.array(rows, np.int64), np.array(owner, np.int64)


def train(texts: list[str], labels: list[int], prior: float, seed: int = 7) -> Network:
    """The network fitted to labelled texts; ``prior`` is the share of label 1 among all labels."""
    net, rng = Network(seed), np.random.default_rng(seed)
    number: dict[str, int] = {}
    windows, owner = _windowed([[number.setdefault(w, len(number)) for w in words_of(t)] for t in texts])
    offsets, rows = features(list(number))
    scale = 1 / np.sqrt(np.diff(offsets)).astype(np.float32)
    y = np.array(labels, np.float32)
    first, second = {k: np.zeros_like(v) for k, v in net.w.items()}, {k: np.zeros_like(v) for k, v in net.w.items()}
    squares = np.full(len(net.table), 1e-4, np.float32)
    steps = 0

    def vectors(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = offsets[own + 1] - offsets[own]
        flat = rows[np.repeat(offsets[own] - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())]
        return flat, n, np.add.reduceat(net.table[flat], np.concatenate([[0], n.cumsum()[:-1]]), axis=0) * scale[own][:, None]

    def scores() -> np.ndarray:
        x = net.projected(np.concatenate([vectors(np.arange(a, min(a + 20_000, len(number))))[2] for a in range(0, len(number), 20_000)]))
        return _scores(net, x, windows)

    def step(chosen: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> None:
        nonlocal steps
        steps += 1
        ids = windows[chosen].T
        mask = (ids >= 0).astype(np.float32)
        own, place = np.unique(ids, return_inverse=True)
        pad = int(own[0] == -1)
        own = own[pad:]
        flat, n, vec = vectors(own)
        vec = np.concatenate([np.zeros((pad, DIM), np.float32), vec])
        place = place.reshape(ids.shape)
        projected = net.projected(vec)
        grads, d_x = net.gradient({d: projected[d][place] for d in "fb"}, mask, target, weight)
        order = np.argsort(place.ravel(), kind="stable")
        cut = np.searchsorted(place.ravel()[order], np.arange(len(vec)))
        d_vec = np.zeros_like(vec)
        for d in "fb":
            by_word = np.add.reduceat((d_x[d] * mask[:, :, None]).reshape(-1, 3 * HIDDEN)[order], cut, axis=0)
            grads |= {f"x{d}": vec.T @ by_word, f"bias{d}": by_word.sum(axis=0)}
            d_vec += by_word @ net.w[f"x{d}"].T
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.w[k] = (net.w[k] - rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
        by_row = np.repeat(d_vec[pad:] * scale[own][:, None], n, axis=0)
        order = np.argsort(flat, kind="stable")
        touched, cut = np.unique(flat[order], return_index=True)
        g = np.add.reduceat(by_row[order], cut, axis=0)
        squares[touched] += (g * g).mean(axis=1)
        net.table[touched] -= 10 * rate * g / np.sqrt(squares[touched])[:, None]

    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    share = np.minimum(1.0, FIRST_PASS / np.bincount(owner, minlength=len(texts)))
    for turn in range(PASSES):
        if turn == 0:
            chosen = rng.permutation(len(windows))
        else:
            score = scores()
            best = np.lexsort((-score, owner))
            top = best[np.concatenate([[True], owner[best][1:] != owner[best][:-1]])]
            spare = rng.permutation(len(windows))[: len(top)]
            chosen = rng.permutation(np.concatenate([top, spare[y[owner[spare]] == 0]]))
        weight = (balance * share if turn == 0 else balance).astype(np.float32)
        size = max(BATCH, len(chosen) // FIRST_STEPS) if turn == 0 else BATCH
        times = max(1, -(-STEPS * BATCH // len(chosen)))
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(times)]) if times > 1 else chosen
        for at in range(0, len(chosen), size):
            part = chosen[at : at + size]
            step(part, y[owner[part]], weight[owner[part]], 0.01 if turn < PASSES - 1 else 0.003)
    score = np.full(len(texts), -np.inf, np.float64)
    np.maximum.at(score, owner, scores())
    net.scale = _platt(score, y, prior)
    return net


def _platt(score: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Slope and intercept of the logistic fit of labels to scores, with the classes weighed by the prior."""
    weight = np.where(y > 0, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g, v = weight * (p - y), weight * p * (1 - p) + 1e-6
        m = np.array([[(v * score * score).sum() + 1.0, (v * score).sum()], [(v * score).sum(), v.sum() + 1e-3]])
        delta = np.linalg.solve(m, [(g * score).sum() + (a - 1.0), g.sum()])
        a, b = a - delta[0], b - delta[1]
    return np.array([max(a, 1e-3), b], np.float32)


def _scores(net: Network, x: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """The logit of every window, block by block; x holds the projected words by number."""
    out = np.empty(len(windows), np.float32)
    for at in range(0, len(windows), BLOCK):
        ids = windows[at : at + BLOCK].T
        mask = (ids >= 0).astype(np.float32)
        out[at : at + BLOCK] = net.logits({d: x[d].take(np.maximum(ids, 0), axis=0) for d in "fb"}, mask)
    return out


class Scorer:
    """Scores texts; remembers the projected inputs of the words it has seen, up to ``KNOWN_WORDS``."""

    def __init__(self, net: Network):
        self.net, self.number, self.x = net, {}, {d: np.empty((0, 3 * HIDDEN), np.float32) for d in "fb"}

    def __call__(self, texts: list[str]) -> np.ndarray:
        """The score of each text, between 0 and 1."""
        a, b = self.net.scale
        return 1 / (1 + np.exp(-np.clip(a * self.highest(texts) + b, -30, 30)))

    def highest(self, texts: list[str]) -> np.ndarray:
        """The highest logit of each text's windows; the windows of a very long text are read in runs."""
        words = [words_of(t) for t in texts]
        if max(map(len, words), default=0) <= RUN_WORDS:
            return self._highest(words)
        return np.array([max(float(self._highest([own[at : at + RUN_WORDS + WINDOW - STRIDE]])[0]) for at in range(0, max(1, len(own) - WINDOW + STRIDE), RUN_WORDS)) for own in words])

    def _highest(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.number) > KNOWN_WORDS:
            self.__init__(self.net)
        before, number = len(self.number), self.number
        windows, owner = _windowed([[number.setdefault(w, len(number)) for w in own] for own in texts])
        fresh = list(number)[before:] if before else list(number)
        if fresh:
            more = self.net.projected(self.net.vectors(fresh))
            self.x = {d: np.concatenate([self.x[d], more[d]]) for d in "fb"}
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, _scores(self.net, self.x, windows))
        return best


def _sample(docs: DataFrame, labels: DataFrame, divisor: int, held_out: int) -> tuple[DataFrame, float | None]:
    """(text, label) of the bounded training sample, and the share of label 1 among the labels that may be learnt from."""
    usable = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id is not null and toxic in (0, 1)")
    usable = usable.where(id_remainder("label_id", divisor) != held_out)
    n, ones = usable.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < ones < n:
        return docs.select("text", F.lit(0).alias("toxic")).limit(0), None
    by_hash = [F.xxhash64("label_id"), "label_id"]
    chosen = usable.where("toxic = 1").orderBy(*by_hash).limit(POSITIVES).unionByName(usable.where("toxic = 0").orderBy(*by_hash).limit(NEGATIVES))
    return docs.join(F.broadcast(chosen), docs.doc_id == chosen.label_id).select("doc_id", "text", "toxic"), ones / n  # POSITIVES + NEGATIVES rows


def fit(docs: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2) -> bytes | None:
    """The trained weights; ``docs`` (doc_id, text), ``labels`` (doc_id, toxic). None without both classes."""
    sample, prior = _sample(docs, labels, divisor, held_out)
    if prior is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(i, t, y) for b in batches for i, t, y in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True)})
        if len({y for _, _, y in rows}) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([train([t for _, t, _ in rows], [y for _, _, y in rows], prior).saved()], pa.binary())], names=["weights"])

    found = sample.repartition(1).mapInArrow(run, "weights binary").collect()
    return bytes(found[0].weights) if found else None


def _scored(weights, kept: str, field: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The column ``kept`` with the score of the text, which is a column, or a field of ``kept``; a few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if weights.value is None else Scorer(Network.load(weights.value))
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                rows = batch.slice(at, STEP)
                column = rows["text"] if field is None else rows[kept].field(field).cast(pa.string())
                score: list[float] = []
                part: list[str] = []
                size = 0
                for text in [*(t or "" for t in column.to_pylist()), None]:  # about ``BYTES`` of text at a time
                    if text is not None:
                        part.append(text)
                        size += len(text)
                    if part and (text is None or size > BYTES):
                        score += scorer(part).tolist() if scorer else [0.0] * len(part)
                        part, size = [], 0
                yield pa.RecordBatch.from_arrays([rows[kept], pa.array(score, pa.float64())], names=[kept, "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row of ``docs``, by a network trained on ``labels`` (doc_id, toxic)."""
    rows = text_rows(docs, id_col, text_col)
    weights = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, divisor, held_out))  # of fixed size
    return rows.select("doc_id", "text").mapInArrow(_scored(weights, "doc_id"), "doc_id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(text_rows(docs, id_col, text_col), labels))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # the text goes to Python once, within its row
    kept = packed.mapInArrow(_scored(weights, "row", docs.columns.index(text_col)), packed.select("row").schema.add("score", "double"))
    return kept.where(F.col("score") < threshold).select("row.*")
