"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A position's input is the sum of a word embedding and the mean of its character embeddings (byte
prefixes, suffixes and 4-grams, hashed).  Two GRUs read a window in both directions; attention
pools their states and the inputs, and a logistic unit scores the window.  A document's score is
that of its worst window; windows overlap and cover the whole text.

Training takes a sample of labelled rows (bounded in rows by ``FitSetup``) and, like scoring, all
windows of their whole texts; so does the choice of the cut between the classes.  A toxic document
need not be toxic in each window, so after the first epochs only its highest windows count as toxic (multiple-instance
learning), and clean documents are shown by their highest windows and a few others.
Words and character features that tell the classes apart in either direction (a two-sample z of
``strong_z`` or more) learn at the full rate, and those of ``prior_z`` start with a sign.  All others that
occur in a share ``weak_share`` of the sample start at zero and learn at ``weak_rate`` of it; rarer ones
stay at zero.  A share of the sample is kept out of training to choose the cut between the classes.

Defined results: texts without a letter or digit, and null texts, score 0; rows are judged alone;
without labelled rows of both classes every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.llm.common import documents, labels, tidy, tidy_driver
from nearpath.llm.wordcore import NOT_WORD, Words, slices

_U = np.uint64


@dataclass(frozen=True)
class FitSetup:
    """Bounds of the training sample, in rows, and sizes of the network."""

    toxic_rows: int = 800
    clean_rows: int = 2000
    window: int = 64
    stride: int = 48
    embed: int = 12
    hidden: int = 8
    attend: int = 8
    word_slots: int = 1 << 15
    char_slots: int = 1 << 15
    strong_z: float = 3.0
    weak_share: float = 0.01
    weak_rate: float = 0.01
    prior_z: float = 4.5
    check_share: float = 0.2
    epochs: int = 6
    updates: int = 200
    batch: int = 512
    rate: float = 0.015
    decay: float = 1e-4
    seed: int = 17


def char_features(w: Words, pick: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, slot) of the character features of the picked words."""
    start, end = w.start[pick], w.end[pick]
    length = end - start
    who, slot = [], []

    def add(rows, low, high, salt):
        who.append(rows)
        slot.append(((w.piece(low, high) * _U(0x9E3779B97F4A7C15) + _U(salt * 0x632BE59BD9B4E019 & (2**64 - 1))) >> _U(40)).astype(np.int64) % slots)

    for n in (3, 4, 5, 6, 7, 8):
        rows = np.flatnonzero(length >= n)
        add(rows, start[rows], start[rows] + n, n)
    for n in (3, 5):
        rows = np.flatnonzero(length >= n)
        add(rows, end[rows] - n, end[rows], 16 + n)
    for at in range(1, 24):
        rows = np.flatnonzero(length >= at + 4)
        if not len(rows):
            break
        add(rows, start[rows] + at, start[rows] + at + 4, 32)
    return np.concatenate(who), np.concatenate(slot)


class Vocabulary:
    """Distinct words of a slice: word slots, character slots and, of each position, its word."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, setup: FitSetup):
        self.words = w = Words(raw, offsets, lower=True, separators=NOT_WORD)
        self.distinct, first, self.at = np.unique(w.hash, return_index=True, return_inverse=True)
        distinct = self.distinct
        self.word_slot = (distinct >> _U(33)).astype(np.int64) % setup.word_slots
        who, slot = char_features(w, first, setup.char_slots)
        order = np.argsort(who, kind="stable")
        self.char_slot = slot[order].astype(np.int32)
        self.edge = np.r_[0, np.cumsum(np.bincount(who, minlength=len(distinct)))]

    @classmethod
    def of_texts(cls, texts: list[str], setup: FitSetup) -> Vocabulary:
        """One vocabulary over many texts, put together slice by slice; of a slice only this outlives it."""
        parts = []
        for _, _, offsets, raw in slices(pa.array(texts, pa.string())):
            one = cls(offsets, raw, setup)
            one.count, one.words, one.at = one.words.count, None, one.at.astype(np.int32)
            parts.append(one)
        out = cls.__new__(cls)
        out.distinct, first, where = np.unique(np.concatenate([p.distinct for p in parts]), return_index=True, return_inverse=True)
        where = where.astype(np.int32)
        base = np.r_[0, np.cumsum([len(p.distinct) for p in parts])]
        out.at = np.concatenate([where[b + p.at] for p, b in zip(parts, base)])
        out.word_slot = np.concatenate([p.word_slot for p in parts])[first]
        n = np.concatenate([np.diff(p.edge) for p in parts])
        start = np.r_[0, np.cumsum(n)[:-1]][first]
        n = n[first]
        out.edge = np.r_[0, np.cumsum(n)]
        chars = np.concatenate([p.char_slot for p in parts])
        count = np.concatenate([p.count for p in parts])
        del parts
        out.char_slot = np.concatenate([chars[a : a + k] for a, k in zip(start.tolist(), n.tolist())]) if len(n) else chars
        out.words = SimpleNamespace(count=count, first=np.r_[0, np.cumsum(count)])
        return out

    def chars(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character slots of the words, one after the other, and how many each has."""
        n = self.edge[words + 1] - self.edge[words]
        at = np.repeat(self.edge[words] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return self.char_slot[at], n

    def inputs(self, p: dict, chunk: int = 1 << 15) -> np.ndarray:
        out = p["Ew"][self.word_slot]
        for low in range(0, len(out), chunk):
            edge = self.edge[low : low + chunk + 1]
            n = np.diff(edge)
            some = np.flatnonzero(n)
            if len(some):
                sums = np.add.reduceat(p["Ec"][self.char_slot[edge[0] : edge[-1]]], edge[some] - edge[0], axis=0)
                out[low + some] += sums / n[some][:, None].astype(np.float32)
        return out


def all_windows(w: Words, setup: FitSetup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first position, length) of every window of a slice."""
    per = np.where(w.count > 0, np.maximum(1, -(-(w.count - setup.window) // setup.stride) + 1), 0)
    doc = np.repeat(np.arange(len(per)), per)
    number = np.arange(len(doc)) - np.r_[0, np.cumsum(per)[:-1]][doc]
    first = w.first[:-1][doc] + number * setup.stride
    return doc, first, np.minimum(setup.window, w.first[1:][doc] - first)


def _sigmoid(x):
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    def __init__(self, params: dict, setup: FitSetup):
        self.p, self.s = params, setup

    @classmethod
    def initial(cls, setup: FitSetup) -> Network:
        rng = np.random.default_rng(setup.seed)
        e, h, a = setup.embed, setup.hidden, setup.attend
        r = lambda *n, scale=0.3: rng.normal(0, scale, n).astype(np.float32)
        p = {"Ew": r(setup.word_slots, e, scale=0.05), "Ec": r(setup.char_slots, e, scale=0.1)}
        for d in "fb":
            p |= {f"W{d}": r(e, 3 * h), f"U{d}": r(h, 2 * h), f"V{d}": r(h, h), f"b{d}": np.zeros(3 * h, np.float32)}
        p |= {"Wa": r(2 * h + e, a), "ba": np.zeros(a, np.float32), "va": r(a), "wo": r(2 * h + e), "bo": np.zeros(1, np.float32)}
        return cls(p, setup)

    def _gru(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction; x is (time, batch, 3h) already projected."""
        p, h = self.p, self.s.hidden
        T, B = x.shape[:2]
        state, states, kept = np.zeros((B, h), np.float32), np.zeros((T, B, h), np.float32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            zr = _sigmoid(x[t, :, : 2 * h] + state @ p[f"U{d}"])
            z, r = zr[:, :h], zr[:, h:]
            rs = r * state
            c = np.tanh(x[t, :, 2 * h :] + rs @ p[f"V{d}"])
            z *= mask[t][:, None]
            if keep:
                kept.append((t, state, z, r, rs, c))
            state = state + z * (c - state)
            states[t] = state
        return states, kept

    def logits(self, at: np.ndarray, mask: np.ndarray, table: np.ndarray, keep: bool = False):
        """Window logits; ``at`` is (time, batch) rows of the input table, mask 1 inside the window."""
        p = self.p
        x = table[at]
        parts, kept = [], []
        for d in "fb":
            projected = (table @ p[f"W{d}"] + p[f"b{d}"])[at]
            states, k = self._gru(d, projected, mask, keep)
            parts.append(states)
            kept.append(k)
        H = np.concatenate([*parts, x], axis=2)
        u = np.tanh(H @ p["Wa"] + p["ba"])
        score = u @ p["va"] + (mask - 1) * 1e4
        score -= score.max(axis=0)
        alpha = np.exp(score) * mask
        alpha /= np.maximum(alpha.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbk->bk", alpha, H)
        out = pooled @ p["wo"] + p["bo"][0]
        return (out, (x, kept, H, u, alpha, pooled)) if keep else out

    def gradients(self, at, mask, table, target, weight):
        p, h = self.p, self.s.hidden
        out, (x, kept, H, u, alpha, pooled) = self.logits(at, mask, table, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("Ew", "Ec")}
        d_out = ((1 / (1 + np.exp(-out)) - target) * weight / max(weight.sum(), 1e-9)).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ d_out, d_out.sum(keepdims=True)
        d_pool = d_out[:, None] * p["wo"]
        dH = alpha[:, :, None] * d_pool
        d_alpha = np.einsum("tbk,bk->tb", H, d_pool)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        du = d_score[:, :, None] * p["va"] * (1 - u * u)
        g["va"] = np.einsum("tb,tba->a", d_score, u)
        g["Wa"], g["ba"] = np.einsum("tbk,tba->ka", H, du), du.sum(axis=(0, 1))
        dH += du @ p["Wa"].T
        dx = dH[:, :, 2 * h :].copy()
        for i, d in enumerate("fb"):
            U, V, W = p[f"U{d}"], p[f"V{d}"], p[f"W{d}"]
            back = np.zeros((at.shape[1], h), np.float32)
            dproj = np.zeros((*at.shape, 3 * h), np.float32)
            for t, state, z, r, rs, c in reversed(kept[i]):
                dh = dH[t, :, i * h : (i + 1) * h] + back
                dc = dh * z * (1 - c * c)
                m = mask[t][:, None]
                dz = dh * (c - state) * z * (1 - z / np.maximum(m, 1e-9)) * (m > 0)
                drs = dc @ V.T
                dr = drs * state * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                g[f"U{d}"] += state.T @ dzr
                g[f"V{d}"] += rs.T @ dc
                dproj[t, :, : 2 * h], dproj[t, :, 2 * h :] = dzr, dc
                back = dh * (1 - z) + drs * r + dzr @ U.T
            flat = dproj.reshape(-1, 3 * h)
            g[f"W{d}"], g[f"b{d}"] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(axis=0)
            dx += (flat @ W.T).reshape(x.shape)
        return g, dx, out


@dataclass
class Model:
    params: dict
    setup: FitSetup = field(default_factory=FitSetup)
    shift: float = 0.0

    def score(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Score of every document of a slice."""
        s, net = self.setup, Network(self.params, self.setup)
        out = np.zeros(len(offsets) - 1)
        v = Vocabulary(offsets, raw, s)
        if not len(v.at):
            return out
        doc, first, length = all_windows(v.words, s)
        table = np.concatenate([v.inputs(self.params), np.zeros((1, s.embed), np.float32)])
        step = np.arange(s.window)[:, None]
        best = np.full(len(out), -np.inf)
        for a in range(0, len(doc), 2048):
            f, n = first[a : a + 2048], length[a : a + 2048]
            inside = step < n
            at = np.where(inside, v.at[np.minimum(f + step, len(v.at) - 1)], len(table) - 1)
            np.maximum.at(best, doc[a : a + 2048], net.logits(at, inside.astype(np.float32), table))
        some = best > -np.inf
        out[some] = 1 / (1 + np.exp(-np.clip(best[some] - self.shift, -60, 60)))
        return out


def train(texts: list[str], toxic: list[int], setup: FitSetup = FitSetup()) -> Model | None:
    """Fit the network on labelled texts; None unless both labels occur."""
    toxic = np.asarray(toxic, dtype=np.float32)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    s, rng = setup, np.random.default_rng(setup.seed)
    v = Vocabulary.of_texts(texts, s)
    net = Network.initial(s)
    p = net.p
    # features of too few documents, or of both classes alike, stay silent
    pairs = np.unique(np.repeat(np.arange(len(toxic)), v.words.count) * len(v.word_slot) + v.at)
    seen_edge = np.searchsorted(pairs, np.arange(len(toxic) + 1) * len(v.word_slot))
    seen_word = (pairs % max(1, len(v.word_slot))).astype(np.int32)
    del pairs
    # rows come in the order of a hash, so every n-th document of a class is a fair share
    rank = np.where(toxic > 0, np.cumsum(toxic > 0), np.cumsum(toxic == 0))
    kept_out = rank % max(2, round(1 / s.check_share)) == 0
    held = np.zeros((2, 2, max(s.word_slots, s.char_slots)))  # (word or char, label, slot): documents
    for d, (low, high) in enumerate(zip(seen_edge[:-1], seen_edge[1:])):
        if not kept_out[d]:
            held[0, int(toxic[d]), np.unique(v.word_slot[seen_word[low:high]])] += 1
            held[1, int(toxic[d]), np.unique(v.chars(seen_word[low:high])[0])] += 1
    sizes = [max(1, int((~kept_out & (toxic == c)).sum())) for c in (0, 1)]
    trust = {}
    for k, (clean, bad), slots in (("Ew", held[0], s.word_slots), ("Ec", held[1], s.char_slots)):
        clean, bad = clean[:slots], bad[:slots]
        share = np.clip((clean + bad) / sum(sizes), 1e-9, 1 - 1e-9)
        z = (bad / sizes[1] - clean / sizes[0]) / np.sqrt(share * (1 - share) * (1 / sizes[0] + 1 / sizes[1]))
        strong = (np.abs(z) >= s.strong_z) & (clean + bad >= 3)
        weak = clean + bad >= s.weak_share * sum(sizes)
        trust[k] = np.where(strong, 1.0, np.where(weak, s.weak_rate, 0.0))[:, None].astype(np.float32)
        p[k][:, 0] += (np.sign(z) * np.clip((np.abs(z) - s.prior_z) / 4, 0, 2)).astype(np.float32)
    for k, m in trust.items():
        p[k] *= m >= 1

    doc, first, length = all_windows(v.words, s)
    label = toxic[doc]
    learn = ~kept_out[doc]
    weight = learn.astype(np.float32)
    step = np.arange(s.window)[:, None]
    m1 = {k: np.zeros_like(a) for k, a in p.items()}
    m2 = {k: np.zeros_like(a) for k, a in p.items()}
    tick = 0

    def batch_of(rows):
        inside = step < length[rows]
        return np.where(inside, v.at[np.minimum(first[rows] + step, len(v.at) - 1)], len(v.word_slot)), inside.astype(np.float32)

    def table_of():
        return np.concatenate([v.inputs(p), np.zeros((1, s.embed), np.float32)])

    def scores():
        table = table_of()
        return np.concatenate([net.logits(*batch_of(np.arange(a, min(a + 1024, len(doc)))), table) for a in range(0, len(doc), 1024)])

    # small samples take more, smaller steps
    size = int(np.clip(learn.sum() // 12, 64, s.batch))
    epochs = max(s.epochs, -(-s.updates * size // max(1, int(learn.sum()))))
    for epoch in range(epochs):
        if epoch >= epochs // 3:
            now = scores()
            best = np.full(len(toxic), -np.inf)
            np.maximum.at(best, doc, now)
            low = np.where(label > 0, np.minimum(best[doc], 1.0), best[doc] - 1.0)
            weight = (learn & ((now >= low) | (label == 0) & (rng.random(len(doc)) < 0.2))).astype(np.float32)
        ratio = (weight * (label == 0)).sum() / max((weight * label).sum(), 1)
        balance = np.where(label > 0, min(ratio, 4.0), 1.0).astype(np.float32) * weight
        alive = np.flatnonzero(balance > 0)
        shuffled = rng.permutation(alive)
        for a in range(0, len(shuffled), size):
            rows = np.sort(shuffled[a : a + size])
            table = table_of() if (a // size) % 4 == 0 else table
            at, mask = batch_of(rows)
            g, dx, _ = net.gradients(at, mask, table, label[rows], balance[rows])
            d_table = np.zeros((len(table), s.embed), np.float32)
            flat = at.ravel()
            by = np.argsort(flat, kind="stable")
            cut_at = np.flatnonzero(np.r_[True, np.diff(flat[by]) != 0])
            d_table[flat[by][cut_at]] = np.add.reduceat(dx.reshape(-1, s.embed)[by], cut_at, axis=0)
            touched = flat[by][cut_at]
            touched = touched[touched < len(v.word_slot)]
            g["Ew"] = np.zeros_like(p["Ew"])
            np.add.at(g["Ew"], v.word_slot[touched], d_table[touched])
            slot, n = v.chars(touched)
            g["Ec"] = np.zeros_like(p["Ec"])
            if len(slot):
                share = np.repeat(d_table[touched] / np.maximum(n, 1)[:, None].astype(np.float32), n, axis=0)
                by = np.argsort(slot, kind="stable")
                cut_at = np.flatnonzero(np.r_[True, np.diff(slot[by]) != 0])
                g["Ec"][slot[by][cut_at]] = np.add.reduceat(share[by], cut_at, axis=0)
            tick += 1
            rate = s.rate * (1 - 0.7 * epoch / epochs) * np.sqrt(1 - 0.999**tick) / (1 - 0.9**tick)
            for k, a_ in p.items():
                grad = g[k] + s.decay * a_
                m1[k] += 0.1 * (grad - m1[k])
                m2[k] += 0.001 * (grad * grad - m2[k])
                step_ = (rate * m1[k] / (np.sqrt(m2[k]) + 1e-7)).astype(np.float32)
                a_ -= step_ * trust[k] if k in trust else step_
    # the cut between the classes: worst window a document; wrongly rejecting clean text counts double
    best = np.full(len(toxic), -np.inf)
    np.maximum.at(best, doc, scores())
    known = (best > -np.inf) & kept_out
    if not (known & (toxic > 0)).any():
        known = best > -np.inf
    value, truth = best[known], toxic[known] > 0
    order = np.argsort(value)
    errors = np.r_[0, np.cumsum(truth[order])] + 2 * ((~truth).sum() - np.r_[0, np.cumsum(~truth[order])])
    lows = np.flatnonzero(errors == errors.min())
    mid = int(lows[len(lows) // 2])
    around = np.r_[value[order][0] - 1, value[order], value[order][-1] + 1]
    return Model(p, s, float((around[mid] + around[mid + 1]) / 2))


def sample(docs: DataFrame, marks: DataFrame, setup: FitSetup = FitSetup()) -> DataFrame:
    """draw, toxic and text of labelled documents, bounded in rows only: whole texts, chosen by a hash of
    their ids.  Of rows that repeat an id the smallest text stands for all, so the bound holds."""
    usable = marks.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", F.lit(setup.seed)).alias("draw")).distinct()
    few = usable.filter("toxic = 1").orderBy("draw").limit(setup.toxic_rows).union(usable.filter("toxic = 0").orderBy("draw").limit(setup.clean_rows))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    return texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "draw", "toxic").agg(F.min("text").alias("text")).select("draw", "toxic", "text")


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(held.value)
        for batch in batches:
            for at, to, offsets, raw in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(own.score(offsets, raw), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def held_out(id_col: F.Column) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, marks: DataFrame, setup: FitSetup = FitSetup()) -> Model | None:
    """Train on the contract's rows, those that are not held out; on the driver, which has the memory for
    the bounded sample that a busy executor may lack."""
    rows = sample(docs, marks.filter(~held_out(F.col("doc_id"))), setup).toArrow().sort_by([(c, "ascending") for c in ("draw", "toxic", "text")])
    texts, toxic = rows["text"].to_pylist(), rows["toxic"].to_pylist()
    del rows
    tidy_driver(docs.sparkSession)  # the heap that reading took is not held beside the training
    model = train(texts, toxic, setup)
    del texts
    tidy_driver(docs.sparkSession)
    return model


def drop_toxic(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Documents that score below one half, all columns as they came; each row is judged by its own text."""
    model = fit(docs, marks)
    if model is None:
        return docs
    held, place = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model)), docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(held.value)
        for batch in batches:
            for at, to, offsets, raw in slices(batch.column(place)):
                yield batch.slice(at, to - at).filter(pa.array(own.score(offsets, raw) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_documents(docs, fit(docs, labels(spark, sf_dir)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
