"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters the network as its word input (a learned embedding of its hash, and how far the word leans to toxic texts
among the labelled ones) and its character input (learned embeddings of its hashed 3- to 5-grams of characters, pooled,
and how far these lean). A forward and a backward gated unit run over each window of words, attention pools their
states, and a logistic unit scores the window. Every text is covered whole by overlapping windows; its score is that of
its highest window. Labels are of texts, not windows: training takes from each toxic text the window that scores
highest so far, and from each clean one its highest and another, and chooses anew in each round.

The labelled texts that it is fitted on are a bounded sample (`LEARN` of each class, chosen by a hash of the id).
"""

from __future__ import annotations

import gc
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .langid import held_out

#: Labelled texts of each class that the network is fitted on, at most.
LEARN = {1: 1000, 0: 2000}
WINDOW, STRIDE, HIDDEN, EMBED, ATTEND = 64, 48, 8, 4, 8
BUCKETS = 1 << 18
ROUNDS, BATCH, RATE, SEED = 5, 256, 0.01, 7
#: Steps of training at least.
UPDATES = 100
#: Words that one Python worker remembers; characters of a word after which it is cut into overlapping parts.
REMEMBER, LONGEST = 200_000, 32
LEANS = 5
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    """Lower-case words; a very long one as parts that overlap."""
    if not text:
        return []
    found = _WORD.findall(text.lower())
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [p for w in found for p in ([w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - 8, LONGEST - 8)])]


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's bucket; the buckets of all n-grams of characters, and where each word's begin."""
    text = "".join(f"<{w}>" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    base = np.uint64(0x9E3779B97F4A7C15)
    found, of = [], []
    h = c
    for n in range(2, 6):
        h = h[:-1] * base + c[n - 1 :] if len(h) > 1 else h[:0]
        if n >= 3:
            inside = word[: len(h)] == word[n - 1 : n - 1 + len(h)]
            found.append((h[inside] ^ (h[inside] >> np.uint64(29))) * base >> np.uint64(46))
            of.append(word[: len(h)][inside])
    grams, of = np.concatenate(found).astype(np.int64), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[order], np.arange(len(words)))
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    powers = base ** np.arange(LONGEST + 3, dtype=np.uint64)
    place = np.arange(len(c)) - first[word]
    whole = np.add.reduceat(c * powers[np.minimum(place, LONGEST + 2)], first)
    return ((whole ^ (whole >> np.uint64(31))) * base >> np.uint64(46)).astype(np.int64), grams[order], begin


@dataclass
class Network:
    lean_word: np.ndarray
    lean_gram: np.ndarray
    p: dict[str, np.ndarray]
    #: what one worker remembers: word to row, and the rows' gate inputs
    index: dict[str, int] = field(default_factory=dict)
    gates: np.ndarray | None = None

    @staticmethod
    def fresh(lean_word: np.ndarray, lean_gram: np.ndarray) -> Network:
        r = np.random.default_rng(SEED)
        d, h = LEANS + 2 * EMBED, HIDDEN
        n = lambda *s: (r.standard_normal(s) * 0.2).astype(np.float32)
        p = {"E": n(BUCKETS >> 4, EMBED) * 0.2, "C": n(BUCKETS >> 4, EMBED) * 0.2, "W": n(2, d, 3 * h), "U": n(2, h, 3 * h), "b": np.zeros((2, 1, 3 * h), np.float32), "A": n(2 * h, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": n(ATTEND), "o": n(2 * h), "c": np.zeros(1, np.float32)}
        return Network(lean_word, lean_gram, p)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        whole, grams, begin = _hashes(words)
        g = self.lean_gram[grams]
        n = np.diff(np.append(begin, len(grams)))
        lean = np.stack([np.maximum.reduceat(g, begin), np.add.reduceat(g, begin) / n, self.lean_word[whole], np.minimum.reduceat(g, begin), np.log(n).astype(np.float32) - 3], 1) / 2
        e, c = whole >> 4, grams >> 4
        pooled = np.add.reduceat(self.p["C"][c], begin) / n[:, None]
        return np.concatenate([lean, self.p["E"][e], pooled], 1).astype(np.float32), (e, c, n)

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of each word's gate inputs."""
        fresh = set(words).difference(self.index)
        if self.gates is None or len(self.index) + len(fresh) > len(self.gates[0]):
            self.index, fresh = {}, set(words)
            self.gates = np.empty((2, max(REMEMBER, len(fresh)), 3 * HIDDEN), np.float32)
        if fresh:
            new, at = list(fresh), len(self.index)
            self.fill(new, self.gates[:, at : at + len(new)])
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def fill(self, words: list[str], out: np.ndarray) -> None:
        """The gate inputs of words, some thousands at a time, as their n-grams are many."""
        for i in range(0, len(words), 8192):
            x, _ = self.inputs(words[i : i + 8192])
            out[:, i : i + 8192] = x @ self.p["W"] + self.p["b"]

    def run(self, gates: np.ndarray, on: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows. gates: direction, window, step, 3 * HIDDEN; on: window, step."""
        p, h = self.p, HIDDEN
        _, n, steps, _ = gates.shape
        state = np.zeros((2, n, h), np.float32)
        out = np.empty((2, n, steps, h), np.float32)
        trail = []
        for t in range(steps):
            where = (t, steps - 1 - t)
            g = np.stack([gates[0, :, where[0]], gates[1, :, where[1]]])
            m = np.stack([on[:, where[0]], on[:, where[1]]])[:, :, None]
            u = state @ p["U"]
            zr = 1 / (1 + np.exp(-(g[..., : 2 * h] + u[..., : 2 * h])))
            z, r = zr[..., :h], zr[..., h:]
            c = np.tanh(g[..., 2 * h :] + r * u[..., 2 * h :])
            new = np.where(m, state + z * (c - state), state)
            if keep:
                trail.append((state, z, r, c, u[..., 2 * h :], m))
            state = new
            out[0, :, where[0]], out[1, :, where[1]] = state[0], state[1]
        both = np.concatenate([out[0], out[1]], 2)
        q = np.tanh(both @ p["A"] + p["a"])
        s = np.where(on, q @ p["v"], -1e9)
        s = np.exp(s - s.max(1, keepdims=True)) * on
        alpha = s / np.maximum(s.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", alpha, both)
        return pooled @ p["o"] + p["c"][0], {"trail": trail, "both": both, "q": q, "alpha": alpha, "pooled": pooled}

    def backward(self, kept: dict, on: np.ndarray, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The gradients, and those of the gate inputs."""
        p, h, g = self.p, HIDDEN, {}
        both, q, alpha = kept["both"], kept["q"], kept["alpha"]
        g["o"], g["c"] = d_logit @ kept["pooled"], d_logit.sum(keepdims=True)
        d_pool = d_logit[:, None] * p["o"]
        d_both = alpha[:, :, None] * d_pool[:, None]
        d_alpha = np.einsum("nth,nh->nt", both, d_pool)
        d_s = alpha * (d_alpha - (alpha * d_alpha).sum(1, keepdims=True))
        g["v"] = np.einsum("nt,nta->a", d_s, q)
        d_q = d_s[:, :, None] * p["v"] * (1 - q * q)
        g["a"], g["A"] = d_q.sum((0, 1)), np.einsum("nth,nta->ha", both, d_q)
        d_both = d_both + d_q @ p["A"].T
        steps = on.shape[1]
        d_gates = np.zeros((2, len(on), steps, 3 * h), np.float32)
        g["U"] = np.zeros_like(p["U"])
        d_state = np.zeros((2, len(on), h), np.float32)
        for t in range(steps - 1, -1, -1):
            where = (t, steps - 1 - t)
            d_state = d_state + np.stack([d_both[:, where[0], :h], d_both[:, where[1], h:]])
            state, z, r, c, uc, m = kept["trail"][t]
            d_new = np.where(m, d_state, 0)
            d_c = d_new * z * (1 - c * c)
            d_u = np.concatenate([d_new * (c - state) * z * (1 - z), d_c * uc * r * (1 - r), d_c * r], 2)
            d_g = np.concatenate([d_u[..., : 2 * h], d_c], 2)
            g["U"] += np.swapaxes(state, 1, 2) @ d_u
            d_gates[0, :, where[0]], d_gates[1, :, where[1]] = d_g[0], d_g[1]
            d_state = np.where(m, d_new * (1 - z), d_state) + d_u @ np.swapaxes(p["U"], 1, 2)
        return g, d_gates

    def windows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of texts: the places of each window's words among all words, which are real, and each window's text."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(n) - n
        count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
        of = np.repeat(np.arange(len(texts)), count)
        k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        place = (first[of] + k * STRIDE)[:, None] + np.arange(WINDOW)
        on = place < (first + n)[of][:, None]
        return np.where(on, place, 0), on, of, [w for t in texts for w in t]

    def score(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logit of every window of the texts, the text of each, and each text's highest (-inf without words)."""
        place, on, of, words = self.windows(texts)
        best = np.full(len(texts), -np.inf)
        if not len(of):
            return np.zeros(0), of, best
        rows, logit = self.rows(words), np.empty(len(of))
        for at in range(0, len(of), 512):
            logit[at : at + 512], _ = self.run(self.gates[:, rows[place[at : at + 512]]], on[at : at + 512])
        np.maximum.at(best, of, logit)
        return logit, of, best


def leaning(texts: list[list[str]], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket of words and of n-grams, how far it leans to toxic texts: the log odds of the share of texts that
    have it, less what chance alone may give."""
    seen = {k: (np.zeros(BUCKETS), np.zeros(BUCKETS)) for k in ("word", "gram")}
    for words, t in zip(texts, toxic, strict=True):
        if words:
            whole, grams, _ = _hashes(list({*words}))
            seen["word"][int(t)][np.unique(whole)] += 1
            seen["gram"][int(t)][np.unique(grams)] += 1
    total = (max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum())))

    def lean(clean: np.ndarray, bad: np.ndarray) -> np.ndarray:
        odds = np.log((bad + 0.5) / total[1]) - np.log((clean + 0.5) / total[0])
        sure = 1.2 * np.sqrt(1 / (bad + 0.5) + 1 / (clean + 0.5))
        return (np.sign(odds) * np.clip(np.abs(odds) - sure, 0, 5) * (bad + clean > 0)).astype(np.float32)

    return lean(*seen["word"]), lean(*seen["gram"])


def train(texts: list[str | None], toxic: np.ndarray, rounds: int = ROUNDS) -> Network:
    words = [[sys.intern(w) for w in tokens(t)] for t in texts]  # one string for each different word
    texts.clear()
    own = [i for i, w in enumerate(words) if w]
    words, toxic = [words[i] for i in own], np.asarray(toxic)[own].astype(np.float32)
    net = Network.fresh(*leaning(words, toxic))
    if not own or toxic.min() == toxic.max():
        net.p["o"][:] = 0
        net.p["c"][:] = 20.0 * (toxic[0] - 0.5) if own else -10
        return net
    place, on, of, flat = net.windows(words)
    names = sorted({*flat})
    number = {w: i for i, w in enumerate(names)}
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    r = np.random.default_rng(SEED)
    first, count = np.searchsorted(of, np.arange(len(words))), np.bincount(of, minlength=len(words))
    size = len(words)
    ids, place = ids.astype(np.int32), place.astype(np.int32)
    del words, flat, number  # the driver keeps numbers alone
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    share, step = toxic.mean(), 0
    # few texts make few steps: smaller batches and more rounds then
    batch = int(np.clip(size // 16, 16, BATCH))
    rounds = max(rounds, min(25, -(-UPDATES * batch // size)))
    for turn in range(rounds):
        if turn:
            gates, logit = np.empty((2, len(names), 3 * HIDDEN), np.float32), np.empty(len(of))
            net.fill(names, gates)
            for at in range(0, len(of), 512):
                logit[at : at + 512], _ = net.run(gates[:, ids[place[at : at + 512]]], on[at : at + 512])
            del gates
        else:  # before anything is learned, the windows whose words lean most
            lean = np.concatenate([np.maximum(x[:, 0], 0) + np.maximum(x[:, 2], 0) for i in range(0, len(names), 8192) for x in [net.inputs(names[i : i + 8192])[0]]])
            logit = np.concatenate([(lean[ids[place[at : at + 4096]]] * on[at : at + 4096]).sum(1) for at in range(0, len(of), 4096)])
        order = np.lexsort((-logit, of))
        top = order[first]
        other = first + r.integers(0, count)
        chosen = np.concatenate([top, other[(toxic == 0) & (count > 1)]])
        r.shuffle(chosen)
        net.index, net.gates = {}, None
        for at in range(0, len(chosen), batch):
            w = chosen[at : at + batch]
            used, local = np.unique(ids[place[w]], return_inverse=True)
            local = local.reshape(len(w), WINDOW)
            x, (e, c, n) = net.inputs([names[i] for i in used])
            gates = (x @ net.p["W"] + net.p["b"])[:, local]
            out, kept = net.run(gates, on[w], keep=True)
            y = toxic[of[w]]
            weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share) / 2)
            d = ((1 / (1 + np.exp(-out)) - y) * weight / len(w)).astype(np.float32)
            g, d_gates = net.backward(kept, on[w], d)
            d_x = np.zeros((2, len(used), 3 * HIDDEN), np.float32)
            for k in (0, 1):
                np.add.at(d_x[k], local.ravel(), d_gates[k].reshape(-1, 3 * HIDDEN))
            g["b"] = d_x.sum(1, keepdims=True)
            g["W"] = np.swapaxes(x[None], 1, 2) @ d_x
            d_in = (d_x @ np.swapaxes(net.p["W"], 1, 2)).sum(0)
            g["E"], g["C"] = np.zeros_like(net.p["E"]), np.zeros_like(net.p["C"])
            np.add.at(g["E"], e, d_in[:, LEANS : LEANS + EMBED])
            np.add.at(g["C"], c, np.repeat(d_in[:, LEANS + EMBED :] / n[:, None], n, 0))
            step += 1
            for k, v in g.items():
                m1, m2 = moments[k]
                m1 += 0.1 * (v - m1)
                m2 += 0.001 * (v * v - m2)
                net.p[k] -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-7)
    net.index, net.gates = {}, None
    return net


def fit(docs: DataFrame, labels: DataFrame, most: dict[int, int] | None = None) -> Network:
    """Fits on labelled rows that are not held out; of repeated labels the highest counts, null ones are left out. Of
    rows that repeat an id the least text counts."""
    most = most or LEARN
    labels = runtime.pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [r for k, n in most.items() for r in labels.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    if not ids:
        return train([], np.zeros(0))
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")  # bounded by `most`
    rows = runtime.pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    texts, toxic = [r["text"] for r in rows], np.array([r["toxic"] for r in rows])
    del rows
    net = train(texts, toxic)
    gc.collect()
    runtime.trim()
    return net


def _scores(own: Network, column: pa.Array) -> np.ndarray:
    _, off = runtime.utf8(column)
    s = np.zeros(len(column))
    for lo, hi in runtime.steps(off):
        _, _, best = own.score([tokens(t) for t in column.slice(lo, hi - lo).to_pylist()])
        s[lo:hi] = np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best, -50, 50))), 0)
    return s


def clean(docs: DataFrame, net: Network, threshold: float = 0.7) -> DataFrame:
    """The rows that score below the threshold, with all their columns, whatever they are called.

    A text that is null, empty or without a word scores 0 and stays. Ids are not looked at: null and repeated ones are
    rows as any others. An empty table gives no rows.
    """
    flat, names = runtime.numbered(docs)
    shared = runtime.Shared(docs.sparkSession, (net.lean_word, net.lean_gram, net.p), Network)
    text = names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runtime.alone("toxicity", runtime._held.clear)
        for b in batches:
            yield b.filter(pa.array(_scores(shared.get(), b.column(text)) < threshold))
        runtime.trim()

    return flat.mapInArrow(keep, flat.schema).toDF(*names)


def score(docs: DataFrame, net: Network, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    A text that is null, empty or without a word scores 0. Null ids and repeated rows pass through, a row each; columns
    other than doc_id and text are not looked at.
    """
    shared = runtime.Shared(docs.sparkSession, (net.lean_word, net.lean_gram, net.p), Network)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runtime.alone("toxicity", runtime._held.clear)
        for b in batches:
            s = _scores(shared.get(), b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = runtime.pick(docs, "doc_id", "text").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")
