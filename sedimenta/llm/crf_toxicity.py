"""Toxicity by a linear-chain conditional random field over tokens.

Labels mark documents, not tokens, so labelled tokens are made first: features
of tokens (the word, its prefixes) that stand nearly only in toxic documents of
a bounded sample mark their tokens in these documents as toxic. A two-state CRF
is trained on windows of the sample's tokens by gradient ascent. Forward-backward
marginals of whole texts give each token's probability; their sum, density and
maximum go through a logistic regression, fitted on the sample with weights
that restore the share of toxic rows, to a document score. Runs of tokens with
a marginal of a half or more are the offending spans.

All weights and all tokens count: with two states, the recursions need one ratio
a token, so that a text is passed in two runs over floats.

A very long text is scored whole: its words and a few numbers for each are held.

Defined results: a null text counts as empty; empty texts get the score that the
regression gives to no toxic tokens; without labels of both kinds every score is
the share of toxic labels (0 without any); a document labelled more than once
counts each time; repeated rows and null ids stay; further columns are neither
read nor returned.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table

#: Sampled rows of each label, in the order of a hash of doc_id, and the longest text among them in characters.
PER_LABEL = {1: 1500, 0: 3000}
SAMPLE_CHARS = 20_000
#: A feature marks tokens if it stands in so many sampled toxic documents, which are such a share of those it stands in.
SEED_DOCS, SEED_SHARE = 4, 0.85
PREFIXES = (3, 4, 5, 6)
#: Training: tokens of a window, windows without a toxic token for each with one, steps, step size, L2.
WINDOW, CLEAN_WINDOWS, STEPS, RATE, L2 = 32, 2, 60, 0.3, 1e-4
#: Windows of a training set, in the order of a hash; only windows that a text or a seed feature has no other of may exceed it.
MOST_WINDOWS = 6000
#: Entries of a worker's table of words.
TABLE = 50_000
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def token_features(token: str) -> list[str]:
    """Features of a token: its letters as a word, and their prefixes."""
    w = _EDGES.sub("", token)
    return [f"={w}", *(w[:k] for k in PREFIXES if len(w) >= k)] if w else []


class Crf:
    """States 0 (clean) and 1 (toxic): log potentials trans[i, j], start[j]; emission of state 1 against 0 by bias and weights."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, start: np.ndarray):
        self.weights, self.bias, self.trans, self.start = weights, bias, trans, start
        #: exp of the emission of words.
        self.known: dict[str, float] = {}

    def emission(self, token: str) -> float:
        """Of a token: the bias and the weights of its features."""
        return self.bias + sum(self.weights.get(f, 0.0) for f in token_features(token))

    def active(self, words: list[str]) -> list[tuple[int, float]]:
        """Places of all tokens with exp of their emissions."""
        known = self.known
        if new := set(words).difference(known):
            if len(known) + len(new) > TABLE:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = math.exp(max(-50.0, min(self.emission(w), 50.0)))
        return [(i, known[w]) for i, w in enumerate(words)]

    def marginals(self, n: int, active: list[tuple[int, float]]) -> list[float]:
        """P(toxic) of each of n tokens: forward and backward ratios of state 1 to state 0."""
        if not n:
            return []
        (t00, t01), (t10, t11) = np.exp(self.trans - self.trans.max()).tolist()
        forward, r = [], None
        for _, x in active:
            r = x * math.exp(self.start[1] - self.start[0]) if r is None else x * (t01 + t11 * r) / (t00 + t10 * r)
            forward.append(r)
        out, b = [], 1.0
        for k in range(n - 1, -1, -1):
            q = forward[k] * b
            out.append(q / (1.0 + q))
            y = active[k][1] * b
            b = (t10 + t11 * y) / (t00 + t01 * y)
        return out[::-1]


def summary(n: int, p: list[float]) -> list[float]:
    """What the regression sees of a document: bounded maps of the sum, the density and the maximum of its marginals."""
    s = sum(p)
    return [math.log1p(s), math.log1p(100 * s / max(n, 1)), max(p, default=0.0), min(s, 3.0) / 3]


class Model:
    def __init__(self, crf: Crf | None, coefficients: np.ndarray, prior: float):
        self.crf, self.coefficients, self.prior = crf, coefficients, prior

    def of(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """Score of a document, and marginals of its tokens by place."""
        if self.crf is None:
            return self.prior, []
        words = tokens(text)
        active = self.crf.active(words)
        p = self.crf.marginals(len(words), active)
        z = self.coefficients[0] + float(np.dot(self.coefficients[1:], summary(len(words), p)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), [(i, x) for (i, _), x in zip(active, p, strict=True)]

    def spans(self, text: str | None, marginals: list[tuple[int, float]] | None = None) -> list[tuple[int, int, float]]:
        """Offending spans as (first, end) offsets of code points, with the largest marginal: neighbouring toxic tokens are one span."""
        toxic = {i: p for i, p in (self.of(text)[1] if marginals is None else marginals) if p >= 0.5}
        out: list[tuple[int, int, float]] = []
        if toxic:
            last = -2
            for i, m in enumerate(re.finditer(r"\S+", text or "")):
                if i in toxic:
                    if i == last + 1:
                        a, _, p = out.pop()
                        out.append((a, m.end(), max(p, toxic[i])))
                    else:
                        out.append((m.start(), m.end(), toxic[i]))
                    last = i
        return out


def signature(words: list[str]) -> int:
    """Near copies mostly share it: the least hash of a text's runs of three words."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def seed_features(texts: list[tuple[str, int]], weight: dict[int, float]) -> set[str]:
    """Features that stand nearly only in toxic documents; shares count each row by its weight. Only features of several toxic ones are counted in clean ones."""
    toxic = Counter(f for x, y in texts if y for f in features_of(x))
    toxic = Counter({f: n for f, n in toxic.items() if n >= SEED_DOCS})
    clean = Counter(f for x, y in texts if not y for f in features_of(x) if f in toxic)
    return {f for f, n in toxic.items() if n * weight[1] >= SEED_SHARE * (n * weight[1] + clean[f] * weight[0])}


def features_of(text: str) -> set[str]:
    return {f for w in set(tokens(text)) for f in token_features(w)}


def train_crf(windows: list[tuple[list[list[int]], list[int]]], size: int) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, transitions and start by full-batch Adam on the exact gradient; windows: feature numbers and state of each token, equal lengths padded by masks."""
    b = len(windows)
    width = max(len(y) for _, y in windows)
    mask, states = np.zeros((b, width), bool), np.zeros((b, width), np.int64)
    owner: list[int] = []
    feature: list[int] = []
    for i, (xs, ys) in enumerate(windows):
        mask[i, : len(ys)] = True
        states[i, : len(ys)] = ys
        for t, fs in enumerate(xs):
            owner += [i * width + t] * len(fs)
            feature += fs
    owner_a, feature_a = np.array(owner, np.int64), np.array(feature, np.int64)
    theta = np.zeros(size + 1 + 4 + 2)
    theta[size] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(b)
    for k in range(1, STEPS + 1):
        w, bias, trans, start = theta[:size], theta[size], theta[size + 1 : size + 5].reshape(2, 2), theta[size + 5 :]
        e = np.bincount(owner_a, w[feature_a], b * width).reshape(b, width) + bias
        alpha, beta = np.zeros((b, width, 2)), np.zeros((b, width, 2))
        alpha[:, 0] = start
        alpha[:, 0, 1] += e[:, 0]
        for t in range(1, width):
            a0, a1, on = alpha[:, t - 1, 0], alpha[:, t - 1, 1], mask[:, t]
            alpha[:, t, 0] = np.where(on, np.logaddexp(a0 + trans[0, 0], a1 + trans[1, 0]), a0)
            alpha[:, t, 1] = np.where(on, np.logaddexp(a0 + trans[0, 1], a1 + trans[1, 1]) + e[:, t], a1)
        for t in range(width - 2, -1, -1):
            b0, b1, on = beta[:, t + 1, 0], beta[:, t + 1, 1] + e[:, t + 1], mask[:, t + 1]
            beta[:, t, 0] = np.where(on, np.logaddexp(trans[0, 0] + b0, trans[0, 1] + b1), 0.0)
            beta[:, t, 1] = np.where(on, np.logaddexp(trans[1, 0] + b0, trans[1, 1] + b1), 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        emit = np.stack([np.zeros_like(e), e], axis=2)
        node = np.exp(alpha + beta - z[:, None, None])[:, :, 1] * mask
        gradient = np.zeros_like(theta)
        diff = (states * mask) - node
        gradient[:size] = np.bincount(feature_a, diff.ravel()[owner_a], size)
        gradient[size] = diff.sum()
        pair = alpha[:, :-1, :, None] + trans + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        pair = np.exp(pair) * mask[:, 1:, None, None]
        seen = np.bincount((states[:, :-1] * 2 + states[:, 1:])[mask[:, 1:]], minlength=4)
        gradient[size + 1 : size + 5] = seen - pair.sum(axis=(0, 1)).ravel()
        first = np.exp(alpha[:, 0] + beta[:, 0] - z[:, None])
        gradient[size + 5 :] = np.bincount(states[rows, 0], minlength=2) - first.sum(axis=0)
        gradient = gradient / b - L2 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:size], float(theta[size]), theta[size + 1 : size + 5].reshape(2, 2), theta[size + 5 :]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -40, 40)))
        g = x.T @ (weight * (y - p)) - 0.01 * c
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(c))
        step = np.linalg.solve(h, g)
        c = c + np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return c


def choose_windows(texts: list[str], seeds: set[str], is_marked) -> list[tuple[int, int]]:
    """(text, first token) of the windows to train on, [] if none is marked.

    By a hash of text and place: of each text, and of each seed feature, the first window with a marked word, whatever the
    bound; then others with marked words, and CLEAN_WINDOWS without for each of them, within MOST_WINDOWS.
    """
    marked: list[tuple[int, int, int]] = []
    clean: list[tuple[int, int, int]] = []
    for k, x in enumerate(texts):
        ws = tokens(x)
        own = {w for w in set(ws) if is_marked(w)}
        sign = signature(ws)
        for at in range(0, len(ws), WINDOW):
            h = zlib.crc32(f"{sign} {at}".encode())
            (clean if own.isdisjoint(ws[at : at + WINDOW]) else marked).append((h, k, at))
        if len(clean) > 4 * MOST_WINDOWS:
            clean = sorted(clean)[:MOST_WINDOWS]
    marked.sort()
    first: list[tuple[int, int]] = []
    rest: list[tuple[int, int]] = []
    seen_texts: set[int] = set()
    seen: set[str] = set()
    for _, k, at in marked:
        own_seeds = {f for w in set(tokens(texts[k])[at : at + WINDOW]) for f in token_features(w)} & seeds
        (rest if k in seen_texts and own_seeds <= seen else first).append((k, at))
        seen_texts.add(k)
        seen |= own_seeds
    # Room for marked windows: their part of the bound, and what clean ones leave.
    room = max(MOST_WINDOWS // (1 + CLEAN_WINDOWS), MOST_WINDOWS - len(clean))
    first += rest[: max(0, room - len(first))]
    more = min(CLEAN_WINDOWS * len(first), max(MOST_WINDOWS - len(first), MOST_WINDOWS // 2))
    return first + [(k, at) for _, k, at in sorted(clean)[:more]] if first else []


def fit(rows: list[tuple[str, int]], shares: dict[int, float]) -> Model:
    """A model of sampled (text, label); shares: of each label among all labelled rows that aren't held out."""
    prior = shares.get(1, 0.0)
    n = Counter(y for _, y in rows)
    if not n[0] or not n[1]:
        return Model(None, np.zeros(1), prior)
    weight = {y: shares[y] * len(rows) / n[y] for y in (0, 1)}
    # A text that is there many times over says no more of its words than once. Tokens are made again in each pass, so that texts alone are held.
    apart = {(signature(tokens(x)), y): x for x, y in rows}
    texts = [(x, y) for (_, y), x in apart.items()]
    seeds = seed_features(texts, weight)
    is_marked = lambda w: not seeds.isdisjoint(token_features(w))
    chosen = choose_windows([x for x, _ in texts], seeds, is_marked)
    if not chosen:
        return Model(None, np.zeros(1), prior)
    number: dict[str, int] = {}
    windows = []
    for k, at in chosen:
        x, y = texts[k]
        part = tokens(x)[at : at + WINDOW]
        windows.append(([[number.setdefault(f, len(number)) for f in token_features(w)] for w in part], [int(y and is_marked(w)) for w in part]))
    w, bias, trans, start = train_crf(windows, len(number))
    crf = Crf({f: float(w[k]) for f, k in number.items()}, bias, trans, start)
    x = []
    for text, _ in rows:
        ws = tokens(text)
        x.append(summary(len(ws), crf.marginals(len(ws), crf.active(ws))))
    y = np.array([label for _, label in rows], float)
    return Model(crf, logistic(np.array(x), y, np.array([weight[int(k)] for k in y])), prior)


def learn(docs: DataFrame, labels: DataFrame, per_label: dict[int, int] | None = None) -> Model:
    """Fit on a bounded sample of labelled documents that aren't held out; ids are chosen before any text is read."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    shares = {y: n / total for y, n in counts.items()}
    chosen = None
    for y, most in (per_label or PER_LABEL).items():
        part = rows.where(F.col("toxic") == y).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", "text").where(F.char_length("text") <= SAMPLE_CHARS)
    # Some thousand ids at most: PER_LABEL is the bound of what is broadcast, and with SAMPLE_CHARS of what comes back.
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    found = sorted((r["doc_id"], r["toxic"], r["text"]) for r in sample.collect())
    return fit([(text, y) for _, y, text in found], shares)


def score_udf(model: Model):
    """A column function of texts: the score."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([model.of(x)[0] for x in texts.to_pylist()], pa.float64())

    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending spans (first, end, p) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, spans = [], []
            for text in b.column("text").to_pylist():
                own, marginals = model.of(text)
                s.append(own)
                spans.append([{"first": x, "end": y, "p": p} for x, y, p in model.spans(text, marginals)] if own >= 0.5 else [])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(s, pa.float64()), "predicted": pa.array([int(x >= 0.5) for x in s], pa.int32()), "spans": pa.array(spans, SPANS)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<first:int,end:int,p:double>>")


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
