"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is read in windows of WINDOW words that overlap by OVERLAP; every window of the whole text is
scored, and the document's score is that of its worst window. A word enters as the sum of a word
vector (the most telling words of the training rows; others share one vector), the mean of the vectors
of its hashed character trigrams, and the log-odds of its most telling run of 3 to 6 characters. A gated recurrent layer reads the window in either direction,
attention pools the states, and a logistic unit gives the probability.

The labels are of documents, so the training is multiple-instance learning: windows of clean documents
are negative; of a toxic document the window that the present model (at first: word log-odds) holds
worst is positive. At the end a shift of the logit is chosen by the documents' own labels.

The network is fitted on the driver to a bounded sample: POSITIVE toxic and NEGATIVE clean documents,
drawn by a hash of the id, at most TRAIN_WINDOWS windows of each. Scoring is an Arrow UDF over all
rows, a chunk of texts at a time; a worker holds the weights and one chunk.

Edge cases: null, empty and word-less texts score as a window without words would, below 0.5. Null ids
are never learned from and are not held out. Without toxic or without clean labels every score is 0.
Repeated rows get equal scores; several labels of one id count as toxic if one is.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import id_remainder, table
from lakewright.llm.quality import chunks

WINDOW, OVERLAP = 32, 8
HIDDEN, SIZE = 12, 12
VOCABULARY, TRIGRAMS = 2048, 4096
RUNS = 1 << 20
#: Log-odds count from so many standard errors on.
CLEAR = 3.0
POSITIVE, NEGATIVE, TRAIN_WINDOWS = 800, 1600, 10
EPOCHS, BATCH, RATE = 5, 256, 0.01
#: Windows that are run through the network at once.
AT_ONCE = 1024
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def window_starts(n: int) -> range:
    """Starts of the windows over n words; the last one reaches the end."""
    return range(0, max(n - OVERLAP, 1), WINDOW - OVERLAP)


def trigram_means(vocabulary: list[str], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean trigram vector of each word; also the trigrams' numbers and the word of each."""
    raw = [f"<{w}>".encode() for w in vocabulary]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    owner = np.repeat(np.arange(len(raw)), lengths)
    inside = owner[:-2] == owner[2:]
    code = ((b[:-2] * np.uint32(2654435761) ^ b[1:-1]) * np.uint32(2246822519) ^ b[2:]) * np.uint32(3266489917)
    code, owner = ((code >> np.uint32(15)) % np.uint32(TRIGRAMS))[inside], owner[:-2][inside]
    sums = np.zeros((len(raw), vectors.shape[1]), np.float32)
    if len(raw):
        starts = np.searchsorted(owner, np.arange(len(raw)))
        sums = np.add.reduceat(vectors[code], starts, axis=0) / np.maximum(lengths - 2, 1)[:, None].astype(np.float32)
    return sums.astype(np.float32), code, owner


def run_codes(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, below RUNS, of all runs of 3 to 6 bytes of the words and their marked ends, and the word of each."""
    raw = [f"<{w}>".encode() for w in vocabulary]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw)))
    codes, owners, h = [], [], b.copy()
    for n in range(2, 7):
        h = h[:-1] * np.uint32(2654435761) + b[n - 1 :] + np.uint32(n)
        h = h ^ (h >> np.uint32(15))
        if n > 2:
            inside = owner[: len(h)] == owner[n - 1 :]
            codes.append((h * np.uint32(2246822519) >> np.uint32(12))[inside])
            owners.append(owner[: len(h)][inside])
    return np.concatenate(codes), np.concatenate(owners)


def _sum_by(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` by the number in ``at``, below n."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]]))
        out[sorted_at[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights, forward and backward pass. Windows are rows of word numbers, 0 beyond their end."""

    def __init__(self, known: dict[str, float], runs: np.ndarray | None = None, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.known = {w: i for i, w in enumerate(known, 1)}  # 0: any other word
        weight = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        word = 0.1 * r.standard_normal((len(known) + 1, SIZE)).astype(np.float32)
        word[1:, 0] += np.clip(np.array(list(known.values()), np.float32), -3, 3)
        self.runs = runs
        self.p = {"word": word, "char": 0.3 * r.standard_normal((TRIGRAMS, SIZE)).astype(np.float32)}
        for d in ("f", "b"):
            self.p |= {f"W{d}": weight(SIZE, 3 * HIDDEN), f"U{d}": weight(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"att": 0.1 * weight(2 * HIDDEN), "out": weight(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        self.shift = 0.0

    def inputs(self, vocabulary: list[str]):
        """Input vectors of distinct words, and what the backward pass needs."""
        numbers = np.fromiter((self.known.get(w, 0) for w in vocabulary), np.int64, len(vocabulary))
        means, code, owner = trigram_means(vocabulary, self.p["char"])
        x = self.p["word"][numbers] + means
        if self.runs is not None and len(vocabulary):
            x[:, 1] += self.run_odds(vocabulary)
        return x, (numbers, code, owner)

    def run_odds(self, vocabulary: list[str]) -> np.ndarray:
        """The largest log-odds of a word's runs of characters, 0 if none is telling."""
        code, owner = run_codes(vocabulary)
        out, found = np.zeros(len(vocabulary), np.float32), self.runs[code]
        telling = found > 0
        np.maximum.at(out, owner[telling], found[telling].astype(np.float32))
        return out

    def _direction(self, d: str, gates: np.ndarray, idx: np.ndarray, live: np.ndarray, keep: bool):
        """States of one direction, (steps, windows, HIDDEN); ``gates``: what the words alone give."""
        n, steps = idx.shape
        h, U = np.zeros((n, HIDDEN), np.float32), self.p[f"U{d}"]
        states, memory = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g, u = gates[idx[:, t]], h @ U
            zr = _sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            if keep:
                memory.append((t, h, z, r, c, u[:, 2 * HIDDEN :]))
            h = h + (live[:, t, None] * z) * (c - h)
            states[t] = h
        return states, memory

    def forward(self, x: np.ndarray, idx: np.ndarray, keep: bool = False):
        """Logits of windows ``idx`` over the word vectors ``x`` (row 0 is no word)."""
        live = (idx > 0).astype(np.float32)
        gates = {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}
        (sf, mf), (sb, mb) = (self._direction(d, gates[d], idx, live, keep) for d in "fb")
        states = np.concatenate([sf, sb], axis=2)
        a = states @ self.p["att"] - 1e4 * (1 - live.T)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * states).sum(0)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (live, states, a, pooled, {"f": mf, "b": mb})) if keep else logit

    def gradients(self, x: np.ndarray, idx: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Gradients of the weights and of the word vectors, for the mean log loss."""
        logit, (live, states, a, pooled, memory) = self.forward(x, idx, keep=True)
        d = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        dp = d[:, None] * self.p["out"]
        da = (states * dp).sum(2)
        ds = a * (da - (a * da).sum(0))
        dstates = a[:, :, None] * dp + ds[:, :, None] * self.p["att"]
        g["att"] = np.tensordot(ds, states, ((0, 1), (0, 1)))
        dx = np.zeros_like(x)
        for k, dirn in enumerate("fb"):
            part = dstates[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            U, dU, dh = self.p[f"U{dirn}"], np.zeros_like(self.p[f"U{dirn}"]), np.zeros((len(y), HIDDEN), np.float32)
            per_word = np.zeros((*idx.shape, 3 * HIDDEN), np.float32)
            for t, h, z, r, c, uc in reversed(memory[dirn]):
                dh = dh + part[t]
                on = live[:, t, None]
                dz, dc = dh * on * (c - h) * z * (1 - z), dh * on * z * (1 - c * c)
                dr = dc * uc * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], 1)
                per_word[:, t] = np.concatenate([dz, dr, dc], 1)
                dU += h.T @ du
                dh = dh * (1 - on * z) + du @ U.T
            dgates = _sum_by(len(x), idx.reshape(-1), per_word.reshape(-1, 3 * HIDDEN))
            g |= {f"U{dirn}": dU, f"W{dirn}": x.T @ dgates, f"c{dirn}": dgates.sum(0)}
            dx += dgates @ self.p[f"W{dirn}"].T
        return g, dx

    def window_logits(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window of every text, and the text of each."""
        x, idx, owner = encode(self, texts)
        out = [self.forward(x, idx[i : i + AT_ONCE]) for i in range(0, len(idx), AT_ONCE)]
        return (np.concatenate(out) if out else np.zeros(0, np.float32)), owner

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """The probability of each text's worst window."""
        logits, owner = self.window_logits(texts)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, logits.astype(np.float64))
        return _sigmoid(np.clip(worst + self.shift, -50, 50))


def encode(net: Network, texts: list[list[str]]):
    """Vectors of the distinct words, the windows as rows of word numbers, and the text of each window."""
    numbers: dict[str, int] = defaultdict(count(1).__next__)
    flat = [np.fromiter(map(numbers.__getitem__, ws), np.int32, len(ws)) for ws in texts]
    starts = [window_starts(len(ws)) for ws in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    idx = np.zeros((len(owner), WINDOW), np.int32)
    row = 0
    for ids, places in zip(flat, starts, strict=True):
        for s in places:
            part = ids[s : s + WINDOW]
            idx[row, : len(part)] = part
            row += 1
    vectors, _ = net.inputs(list(numbers))
    return np.concatenate([np.zeros((1, SIZE), np.float32), vectors]), idx, owner


def _clear_odds(b: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-odds of being in a toxic document (in b of n[1], and in a of n[0] clean ones), 0 within CLEAR standard errors."""
    p, q = (b + 0.5) / (n[1] + 1), (a + 0.5) / (n[0] + 1)
    odds = np.log(p / (1 - p)) - np.log(q / (1 - q))
    return np.where(np.abs(odds) * np.sqrt(1 / (1 / (b + 0.5) + 1 / (a + 0.5))) >= CLEAR, odds, 0.0)


def _telling(texts: list[list[str]], toxic: np.ndarray) -> tuple[dict[str, float], np.ndarray]:
    """Log-odds of the most telling words, and of all hashed runs of characters."""
    n = np.array([(~toxic).sum(), toxic.sum()], float)
    number: dict[str, int] = defaultdict(count().__next__)
    docs = [np.unique(np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))) for ws in texts]
    seen = np.zeros((2, len(number)))
    for ids, t in zip(docs, toxic.tolist(), strict=True):
        seen[int(t), ids] += 1
    odds, vocabulary = _clear_odds(seen[1], seen[0], n), list(number)
    best = np.argsort(-np.abs(odds), kind="stable")[: VOCABULARY - 1]
    words_found = {vocabulary[i]: float(odds[i]) for i in best if odds[i]}
    code, owner = run_codes(vocabulary) if vocabulary else (np.zeros(0, np.int64),) * 2
    order = np.argsort(owner, kind="stable")
    code, cut = code[order], np.searchsorted(owner[order], np.arange(len(vocabulary) + 1))
    runs = np.zeros((2, RUNS), np.float32)
    for ids, t in zip(docs, toxic.tolist(), strict=True):
        mine = np.concatenate([code[cut[i] : cut[i + 1]] for i in ids.tolist()]) if len(ids) else code[:0]
        runs[int(t), np.unique(mine)] += 1
    return words_found, np.maximum(_clear_odds(runs[1], runs[0], n), 0).astype(np.float16)


def fit(texts: list[list[str]], toxic: np.ndarray, epochs: int = EPOCHS) -> Network | None:
    """The network for word lists with labels; None without both labels."""
    if toxic.all() or not toxic.any():
        return None
    r = np.random.default_rng(11)
    odds, runs = _telling(texts, toxic)
    net = Network(odds, runs)
    distinct = sorted({w for ws in texts for w in ws})
    prior = dict(zip(distinct, net.run_odds(distinct).tolist(), strict=True)) if distinct else {}
    prior = {w: max(v, odds.get(w, 0.0)) for w, v in prior.items()}
    parts, label, owner = [], [], []
    for k, ws in enumerate(texts):
        all_parts = [ws[s : s + WINDOW] for s in window_starts(len(ws))]
        worth = np.array([max((prior[w] for w in p), default=0.0) for p in all_parts])
        take = np.argsort(-worth, kind="stable")[: TRAIN_WINDOWS // 2]
        take = np.unique(np.concatenate([take, r.permutation(len(all_parts))[: TRAIN_WINDOWS // 2]]))
        parts += [all_parts[i] for i in take]
        owner += [k] * len(take)
        label += [worth[i] for i in take]
    owner, worth = np.array(owner), np.array(label)
    vocabulary = sorted({w for p in parts for w in p})
    number = {w: i for i, w in enumerate(vocabulary, 1)}
    idx = np.zeros((len(parts), WINDOW), np.int64)
    for k, p in enumerate(parts):
        idx[k, : len(p)] = [number[w] for w in p]
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, of_toxic = 0, toxic[owner]
    for epoch in range(epochs):
        if epoch:
            x = np.concatenate([np.zeros((1, SIZE), np.float32), net.inputs(vocabulary)[0]])
            worth = np.concatenate([net.forward(x, idx[i : i + AT_ONCE]) for i in range(0, len(idx), AT_ONCE)])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, worth)
        chosen = np.flatnonzero(~of_toxic | (worth >= best[owner]))
        y = of_toxic[chosen].astype(np.float32)
        weight = np.where(y > 0, max(1.0, 0.3 * (len(y) - y.sum()) / max(y.sum(), 1)), 1.0).astype(np.float32)
        order = r.permutation(len(chosen))
        for i in range(0, len(order), BATCH):
            o = order[i : i + BATCH]
            rows, back = np.unique(idx[chosen[o]], return_inverse=True)
            back = back.reshape(len(o), WINDOW)
            if rows[0] != 0:
                rows, back = np.concatenate([[0], rows]), back + 1
            vectors, (numbers, code, at) = net.inputs([vocabulary[j - 1] for j in rows[1:]])
            x = np.concatenate([np.zeros((1, SIZE), np.float32), vectors])
            g, dx = net.gradients(x, back, y[o], weight[o])
            dx = dx[1:]
            g["word"] = _sum_by(len(net.p["word"]), numbers, dx)
            n = np.maximum(np.bincount(at, minlength=len(dx)), 1)[:, None]
            g["char"] = _sum_by(TRIGRAMS, code, (dx / n).astype(np.float32)[at])
            step += 1
            for k, v in g.items():  # Adam
                m, s = state[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    net.shift = _shift(net.scores(texts), toxic)
    return net


def _shift(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The shift of the logit after which 0.5 parts toxic from clean best (by F1, in the middle of the gap)."""
    logit = np.log(np.clip(scores, 1e-9, 1 - 1e-9) / (1 - np.clip(scores, 1e-9, 1 - 1e-9)))
    order = np.argsort(-logit, kind="stable")
    hit = np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + toxic.sum())
    best = int(np.argmax(f1))
    below = logit[order[best + 1]] if best + 1 < len(order) else logit[order[best]] - 2
    return float(-(logit[order[best]] + below) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> tuple[list[list[str]], np.ndarray]:
    """Words and labels of a bounded sample of the labelled documents."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = lambda t, n: known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = drawn(1, positive).unionByName(drawn(0, negative))
    rows = docs.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [words(r["text"]) for r in rows], np.array([r["toxic"] == 1 for r in rows], bool)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """All columns of ``docs`` and ``score``."""
    if net is None:
        return docs.withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # weights of fixed size, 3 MB

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [shared.value.scores([words(t) for t in part]) for part in chunks(texts, 1 << 20)]
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return docs.withColumn("score", score("text"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(id_remainder("doc_id", 5) != 0)
    scored = predict(docs, fit(*training_rows(docs, labels)))
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
