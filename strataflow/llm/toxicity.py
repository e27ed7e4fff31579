"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a hashed word vector beside the mean of hashed character-trigram vectors. Two gated recurrent layers
read a window of words in both directions, attention weighs the states, and a logistic unit gives the window's score. A text's
score is that of its worst window. Windows of the whole text start every STRIDE words, so that any passage of up to
WINDOW - STRIDE + 1 words lies whole in one of them. Training takes for each document of a
bounded labelled sample the window that scores highest, as a label tells only that some passage is toxic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_ROWS, TRIGRAM_ROWS, WIDTH, HIDDEN = 8192, 2048, 8, 8
WINDOW, STRIDE = 48, 24
#: Bytes of the longest word; longer runs between blanks, as of Chinese text or joined words, are read in pieces.
LONGEST_WORD = 62
#: The training sample: documents of either label, none longer than so many characters.
TOXIC_DOCS, CLEAN_DOCS, LONGEST = 900, 1500, 20_000
EPOCHS, BATCH, RATE, SEED = 10, 128, 0.015, 11
THRESHOLD = 0.7
#: Words whose input to the gates a worker remembers.
REMEMBERED = 250_000
_JOINS = re.compile(r"[\W_]+")
_MARKS = ".,;:!?\"'()[]{}*#$%&|<>«»„“”…-_"


def _pieces(run: str) -> list[str]:
    if len(run.lower().encode("utf-8", "replace")) <= LONGEST_WORD:
        return [run]
    out = []
    for part in [p for p in _JOINS.split(run) if p] or [run]:
        size = LONGEST_WORD if part.isascii() else LONGEST_WORD // 4
        out += [part[i : i + size] for i in range(0, len(part), size)]
    return out


def words_of(text: str) -> list[str]:
    """What stands between blanks, in pieces of at most LONGEST_WORD bytes; nothing is left unread but joining marks."""
    out = text.split()
    if max(map(len, out), default=0) * 4 <= LONGEST_WORD:
        return out
    return [p for w in out for p in ((w,) if len(w) * 4 <= LONGEST_WORD else _pieces(w))]


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its row, and the rows of its character trigrams one after another with their number."""
    raw = [b"^" + ((plain := w.lower().strip(_MARKS)) or w).encode("utf-8", "replace") + b"$" for w in words]
    rows = np.fromiter(map(zlib.crc32, raw), dtype=np.int64, count=len(raw)) % WORD_ROWS
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    octets = np.frombuffer(b"".join(raw) + b"\0\0", dtype=np.uint8).astype(np.int64)
    every = (octets[:-2] * 7919 + octets[1:-1] * 104729 + octets[2:] * 1299709) % TRIGRAM_ROWS
    inside = np.arange(len(every)) < np.repeat(np.cumsum(lengths) - 2, lengths)  # not over the end of a word
    return rows, every[inside], lengths - 2


def windows(n: int) -> list[int]:
    """Where windows start in a text of n words: every STRIDE words, the last one ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


@dataclass
class Network:
    """Arrays by name. Gates are ordered update, reset, candidate; f and b are the two directions."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, log_odds: np.ndarray, rng: np.random.Generator) -> Network:
        draw = lambda *shape, s=0.1: rng.normal(0, s, shape).astype(np.float32)
        words = draw(WORD_ROWS, WIDTH)
        words[:, 0] = log_odds
        p = {"words": words, "trigrams": draw(TRIGRAM_ROWS, WIDTH), "out": draw(2 * HIDDEN, s=0.3), "bias": np.zeros(1, np.float32) - 1, "attend": draw(2 * HIDDEN, s=0.3)}
        for d in "fb":
            p |= {f"W{d}": draw(2 * WIDTH, 3 * HIDDEN, s=0.3), f"U{d}": draw(HIDDEN, 3 * HIDDEN, s=0.3), f"B{d}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(p)

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """Input to the gates of both directions for word vectors; row 0 is the filler, which keeps the state."""
        out = np.concatenate([vectors @ self.p[f"W{d}"] + self.p[f"B{d}"] for d in "fb"], axis=-1)
        return out.astype(np.float32)

    def run(self, gates: np.ndarray, filler: np.ndarray, keep: bool = False):
        """Scores (logits) of windows: gates is (steps, windows, 6 HIDDEN), filler (steps, windows)."""
        steps, n = filler.shape
        h2 = 3 * HIDDEN
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        held = {}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            U, at = self.p[f"U{d}"], 0 if d == "f" else h2
            h = np.zeros((n, HIDDEN), np.float32)
            tape = []
            for t in order:
                x = gates[t, :, at : at + h2]
                a = h @ U
                zr = _sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if filler[t].any():
                    new = np.where(filler[t][:, None], h, new)
                if keep:
                    tape.append((t, h, z, r, c, a[:, 2 * HIDDEN :]))
                h = new
                states[t, :, at // 3 : at // 3 + HIDDEN] = h
            held[d] = tape
        e = states @ self.p["attend"]
        e[filler] = -1e9
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", w, states)
        return pooled @ self.p["out"] + self.p["bias"][0], (states, w, pooled, held)

    def gradients(self, gates: np.ndarray, filler: np.ndarray, target: np.ndarray, weight: np.ndarray):
        logit, (states, w, pooled, held) = self.run(gates, filler, True)
        ds = (_sigmoid(logit) - target) * weight / len(target)
        g = {"out": pooled.T @ ds, "bias": np.array([ds.sum()])}
        dpool = ds[:, None] * self.p["out"]
        dstates = w[:, :, None] * dpool[None]
        de = w * (np.einsum("tnk,nk->tn", states, dpool) - np.einsum("nk,nk->n", pooled, dpool)[None])
        g["attend"] = np.einsum("tn,tnk->k", de, states)
        dstates += de[:, :, None] * self.p["attend"]
        dgates = np.zeros_like(gates)
        for d in "fb":
            U, at = self.p[f"U{d}"], 0 if d == "f" else 3 * HIDDEN
            dU, dh = np.zeros_like(U), np.zeros((gates.shape[1], HIDDEN), np.float32)
            for t, before, z, r, c, ac in reversed(held[d]):
                dh = dh + dstates[t, :, at // 3 : at // 3 + HIDDEN]
                live = ~filler[t][:, None]
                own = dh * live
                dc = own * (1 - z) * (1 - c * c)
                dz = own * (before - c) * z * (1 - z)
                dr = dc * ac * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], axis=1)
                dgates[t, :, at : at + 3 * HIDDEN] = dx
                da = np.concatenate([dz, dr, dc * r], axis=1)
                dU += before.T @ da
                dh = own * z + da @ U.T + dh * ~live
            g[f"U{d}"] = dU
        return g, dgates, logit


class _Lexicon:
    """Rows of the words of the training sample."""

    def __init__(self, texts: list[str]) -> None:
        ids: dict[str, int] = {}
        self.docs = [np.array([ids.setdefault(w, len(ids)) for w in words_of(text)], dtype=np.int64) for text in texts]
        self.rows, self.flat, self.sizes = hashed(list(ids))
        self.ends = np.cumsum(self.sizes)

    def vectors(self, p: dict[str, np.ndarray], chosen: np.ndarray) -> np.ndarray:
        starts = self.ends[chosen] - self.sizes[chosen]
        sizes = self.sizes[chosen]
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.repeat(starts - firsts, sizes) + np.arange(sizes.sum())
        self.last = (self.flat[at], np.repeat(np.arange(len(chosen)), sizes))
        mean = np.add.reduceat(p["trigrams"][self.last[0]], firsts) / sizes[:, None]
        return np.concatenate([p["words"][self.rows[chosen]], mean], axis=1)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network | None:
    """A network from a bounded sample; None unless both labels occur."""
    pairs = sorted((t, int(y)) for t, y in zip(texts, labels, strict=True) if t and t.split())
    y = np.array([b for _, b in pairs], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng, lex = np.random.default_rng(seed), _Lexicon([t for t, _ in pairs])
    seen = np.zeros((2, WORD_ROWS))
    for own, label in zip(lex.docs, y, strict=True):
        seen[int(label)][np.unique(lex.rows[own])] += 1
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / (len(y) - y.sum() + 1))
    net = Network.fresh((np.clip(odds, -3, 3) / 2 * (seen.sum(axis=0) >= 5)).astype(np.float32), rng)
    of, cuts = [], []
    for i, own in enumerate(lex.docs):
        for s in windows(len(own)):
            of.append(i)
            cuts.append(np.pad(own[s : s + WINDOW], (0, max(0, WINDOW - len(own))), constant_values=-1))
    of, cuts = np.array(of), np.array(cuts)
    first = np.searchsorted(of, np.arange(len(pairs)))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32) ** 0.5
    odd_rows = np.append(np.clip(odds, -3, 3)[lex.rows] * (seen.sum(axis=0) >= 5)[lex.rows], 0.0)
    step = 0
    for epoch in range(epochs):
        if epoch == 0:
            logit = odd_rows[cuts].max(axis=1)
        else:
            table = np.concatenate([net.gates(lex.vectors(net.p, np.arange(len(lex.rows)))), np.zeros((1, 6 * HIDDEN), np.float32)])
            logit = np.concatenate([net.run(table[cuts[i : i + 2048].T], cuts[i : i + 2048].T < 0)[0] for i in range(0, len(cuts), 2048)])
        best = np.lexsort((np.arange(len(of)), -logit, of))[first]
        clean = np.flatnonzero(y == 0)
        extra = rng.integers(0, np.append(first[1:], len(of))[clean] - first[clean]) + first[clean]
        use, target, weight = np.concatenate([best, extra]), np.concatenate([y, y[clean]]), np.concatenate([balance, balance[clean] * 0.5])
        order = rng.permutation(len(use))
        for b in range(0, len(order), BATCH):
            part = order[b : b + BATCH]
            ids = cuts[use[part]].T
            words, where = np.unique(ids, return_inverse=True)
            where = where.reshape(ids.shape)
            pad = int(words[0] == -1)
            vectors = lex.vectors(net.p, words[pad:])
            gates = net.gates(vectors)
            if pad:
                gates = np.concatenate([np.zeros((1, 6 * HIDDEN), np.float32), gates])
            g, dgates, _ = net.gradients(gates[where], ids < 0, target[part], weight[part])
            sorted_ = np.argsort(where.reshape(-1), kind="stable")
            firsts = np.searchsorted(where.reshape(-1)[sorted_], np.arange(len(words)))
            dwords = np.add.reduceat(dgates.reshape(-1, 6 * HIDDEN)[sorted_], firsts)[pad:]
            dvec = np.zeros_like(vectors)
            for d, at in (("f", 0), ("b", 3 * HIDDEN)):
                own = dwords[:, at : at + 3 * HIDDEN]
                g[f"W{d}"], g[f"B{d}"] = vectors.T @ own, own.sum(axis=0)
                dvec += own @ net.p[f"W{d}"].T
            g["words"], g["trigrams"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["trigrams"])
            np.add.at(g["words"], lex.rows[words[pad:]], dvec[:, :WIDTH])
            grams, owner = lex.last
            np.add.at(g["trigrams"], grams, (dvec[:, WIDTH:] / lex.sizes[words[pad:]][:, None])[owner])
            step += 1
            rate = RATE * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.05)
            for k, v in net.p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.005 * (g[k] ** 2 - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.995**step)) + 1e-7)).astype(np.float32)
    return net


class _Ids(dict):
    """Numbers for words; new ones are listed until their inputs are worked out."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        self.new.append(word)
        return n


class Scorer:
    """Scores whole texts; remembers the gates' input of words seen before."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.ids, self.table = _Ids(), np.zeros((1024, 6 * HIDDEN), np.float32)

    def learn_new(self) -> None:
        new, p = self.ids.new, self.net.p
        if not new:
            return
        rows, grams, sizes = hashed(new)
        means = np.add.reduceat(p["trigrams"][grams], np.cumsum(sizes) - sizes) / sizes[:, None]
        at, end = len(self.ids) + 1 - len(new), len(self.ids) + 1
        if end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((end, 6 * HIDDEN), np.float32)])
        self.table[at:end] = self.net.gates(np.concatenate([p["words"][rows], means], axis=1))
        self.ids.new = []

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        if len(self.ids) > REMEMBERED:
            self.forget()
        cuts, of = [], []
        for i, text in enumerate(texts):
            own = np.array(list(map(self.ids.__getitem__, words_of(text))), dtype=np.int32) if text else np.zeros(0, np.int32)
            for s in windows(len(own)):
                cut = own[s : s + WINDOW]
                cuts.append(cut if len(cut) == WINDOW else np.pad(cut, (0, WINDOW - len(cut))))
                of.append(i)
            if len(cuts) >= 4096 or i == len(texts) - 1 and cuts:
                self.learn_new()
                for b in range(0, len(cuts), 1024):
                    ids = np.array(cuts[b : b + 1024]).T
                    np.maximum.at(out, of[b : b + 1024], _sigmoid(self.net.run(self.table[ids], ids == 0)[0].astype(np.float64)))
                cuts, of = [], []
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, held_out: Column) -> list:
    """(text, toxic) of a bounded sample: rows by the hash of their doc_id, from the labels' own counts.

    Labels that are null, or of no document, are left out; of repeated labels the highest holds.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    bound = lambda y, most: int((1 << 30) * min(1.0, most / max(1, counts.get(y, 0))))
    drawn = rows.where(F.when(F.col("toxic") == 1, place < bound(1, TOXIC_DOCS)).otherwise(place < bound(0, CLEAN_DOCS)))
    most = 2 * (TOXIC_DOCS + CLEAN_DOCS)
    drawn = drawn.orderBy(place, "doc_id").limit(most)
    found = docs.select("doc_id", "text").where(F.length("text").between(1, LONGEST)).join(F.broadcast(drawn), "doc_id")
    return found.select("doc_id", "text", "toxic").dropDuplicates(["doc_id", "text"]).limit(most).collect()


def scored(docs: DataFrame, net: Network | None, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text. Null and empty texts, and all texts if nothing could be learned, score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for texts in batches:
            rows = [t if isinstance(t, str) else None for t in texts]
            out = [scorer.scores(rows[i : i + 256]) if scorer else np.zeros(len(rows[i : i + 256])) for i in range(0, len(rows), 256)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, score(F.col("text").cast("string")))
