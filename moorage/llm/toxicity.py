"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extremes."""

from __future__ import annotations

import math
import string
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, texts_of

STEMS = (4, 5, 6)
# Weight of a term's prior, in documents.
PRIOR_WEIGHT = 6.0
# Taken from every token's log-odds, so that an ordinary text scores below zero.
SLOPE = 1.5
REMEMBERED = 200_000
_EDGES = string.punctuation + "¿¡«»„“”‘’…–—"


def tokens_of(text: str) -> list[str]:
    return text.lower().split()


def terms_of(token: str) -> list[str]:
    """The stems of a token, short to long, and the word itself; none if it has no letter."""
    word = token.strip(_EDGES)
    if not word:
        return []
    return [f"{word[:n]}*" for n in STEMS if len(word) >= n] + [word]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one left-to-right scan.

    A segment is maximal if every proper part of it scores less and no larger segment
    with that property holds it. Each candidate keeps the running total before its first
    score (low) and after its last (high); a new score joins the nearest candidate with a
    smaller low, if that one's high is not larger than the new total.
    """
    found: list[list] = []
    linked: list[int] = []  # for each candidate the nearest one before with a smaller low
    total = 0.0
    for at, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start, low = at, before
        while True:
            near = len(found) - 1
            while near >= 0 and found[near][2] >= low:
                near = linked[near]
            if near < 0 or found[near][3] >= total:
                break
            start, low = found[near][0], found[near][2]
            del found[near:], linked[near:]
        found.append([start, at + 1, low, total])
        linked.append(near)
    return [(start, end, high - low) for start, end, low, high in found]


class ToxicityModel:
    """Token log-odds, extreme-value constants and the final logistic curve."""

    def __init__(self, base: float, shares: dict[str, float]):
        self.base, self.shares = base, shares
        self.decay, self.space = 1.0, 1.0
        self.offset, self.gain = 0.0, 1.0

    def token(self, token: str) -> float:
        """Log-odds of the longest known term against the base rate, less the slope."""
        share = self.base
        for term in terms_of(token):
            share = self.shares.get(term, share)
        odds = math.log(share / (1 - share)) - math.log(self.base / (1 - self.base))
        return odds - SLOPE

    def calibrate(self, extremes: np.ndarray, lengths: np.ndarray) -> None:
        """Fit the decay and search-space constants on clean documents' best segments.

        The best of n independent starts exceeds x with probability
        1 - exp(-space * n * exp(-decay * x)); moments of x - log(n) / decay give both.
        """
        some = extremes > 0
        if some.sum() < 20:
            return
        x, log_n = extremes[some], np.log(lengths[some])
        decay = 1.0
        for _ in range(50):
            shifted = x - log_n / decay
            decay = float(np.clip(math.pi / (math.sqrt(6) * max(shifted.std(), 1e-6)), 0.05, 5.0))
        mean = float((x - log_n / decay).mean())
        self.decay = decay
        self.space = math.exp(decay * mean - 0.5772156649015329)

    def evidence(self, found: list[tuple[int, int, float]], n_tokens: int) -> float:
        """Sum over segments of what they exceed the best expected by chance, in nats."""
        if not n_tokens:
            return 0.0
        chance = math.log(self.space * n_tokens)
        return sum(max(0.0, self.decay * s - chance) for _, _, s in found)

    def probability(self, evidence: float) -> float:
        x = self.offset + self.gain * math.log1p(evidence)
        return 1 / (1 + math.exp(-min(max(x, -500.0), 500.0)))

    def fit_curve(self, evidence: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression on the logarithm of the evidence, with a slight ridge."""
        x = np.stack([np.ones(len(evidence)), np.log1p(evidence)], axis=1)
        w = np.zeros(2)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            gradient = x.T @ (toxic - p) - 0.05 * w
            hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        self.offset, self.gain = float(w[0]), float(w[1])


def _scan(text: str, model: ToxicityModel, held: dict[str, float]) -> tuple[list[tuple[int, int, float]], int]:
    """Segments of a text as token ranges, and its number of tokens."""
    tokens = tokens_of(text)
    for token in tokens:
        if token not in held:
            held[token] = model.token(token)
    if len(held) > REMEMBERED:
        kept = {token: held[token] for token in set(tokens)}
        held.clear()
        held.update(kept)
    scores = np.fromiter([held[t] for t in tokens], np.float64, len(tokens))
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return [], len(tokens)
    # Scores between two hits can only be crossed as a whole: sum them up.
    total = np.concatenate([[0.0], np.cumsum(scores)])
    gaps = total[hits] - np.concatenate([[0.0], total[hits[:-1] + 1]])
    squeezed = list(chain.from_iterable(zip(gaps.tolist(), scores[hits].tolist())))
    at = hits.tolist()
    return [(at[s // 2], at[(e - 1) // 2] + 1, v) for s, e, v in segments(squeezed)], len(tokens)


def learn(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_documents: int = 24_000,
    max_terms: int = 60_000,
) -> ToxicityModel:
    """Fit on labelled documents: about ``max_documents`` different rows at most, picked by a hash
    of key and text, and the ``max_terms`` terms that differ most between the labels.

    The term counts of each half of the sample score the other half, whose words they have
    not seen: these scores give the extreme-value constants (clean documents) and the final
    curve. The model itself takes the counts of both halves.
    """
    marked = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).dropna()
    marked = marked.where(F.col("_label").isin(0, 1)).groupBy("_key").agg(F.max("_label").alias("_label"))
    held = documents.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    total = held.join(marked, "_key").count()
    if not total:
        raise ValueError("no labelled row to learn from")
    limit = min(1.0, max_documents / total) * (1 << 30)
    # By key and text: a key on very many rows brings no more than its share of them, equal rows one.
    hashed = held.select("*", F.xxhash64("_key", "_text").alias("_hash"), F.xxhash64(F.lit(1), "_key", "_text").alias("_twin"))
    rows = hashed.where(F.pmod("_hash", F.lit(1 << 30)) < limit).join(marked, "_key")
    distinct = rows.groupBy("_key", "_hash", "_twin", "_label").agg(F.first("_text").alias("_text"))
    sample = distinct.select("_text", "_label", F.pmod("_twin", F.lit(2)).alias("_half"))

    def count(batch):
        seen: dict[str, list[int]] = {}
        halves, toxic = batch.column(2).to_pylist(), batch.column(1).to_pylist()
        for value, half, bad in zip(texts_of(batch.column(0)), halves, toxic):
            for term in set(chain.from_iterable(map(terms_of, set(tokens_of(value))))):
                seen.setdefault(term, [0, 0, 0, 0])[2 * half + bad] += 1
        columns = list(zip(*seen.values())) if seen else [[]] * 4
        names = ("clean0", "bad0", "clean1", "bad1")
        return {"term": pa.array(list(seen), pa.string())} | {
            name: pa.array(list(column), pa.int64()) for name, column in zip(names, columns)
        }

    sizes = {(r["_half"], r["_label"]): r["count"] for r in sample.groupBy("_half", "_label").count().collect()}
    every = sum(sizes.values())
    base = (sizes.get((0, 1), 0) + sizes.get((1, 1), 0) + 0.5) / (every + 1)
    schema = "term string, clean0 bigint, bad0 bigint, clean1 bigint, bad1 bigint"
    counted = map_rows(sample.select("_text", "_label", F.col("_half").cast("int")), count, schema, "_text")
    terms = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("clean0", "bad0", "clean1", "bad1")])
    bad, number = F.col("bad0") + F.col("bad1"), F.col("clean0") + F.col("bad0") + F.col("clean1") + F.col("bad1")
    kept = (
        terms.where(number >= 3)
        .withColumn("apart", F.abs(bad - number * base) / F.sqrt(number * base))
        .orderBy(F.desc("apart"), "term")
        .limit(max_terms)
        .collect()
    )
    halves = [
        ToxicityModel(base, _shares({r["term"]: (r[f"clean{h}"], r[f"bad{h}"]) for r in kept}, base)) for h in (0, 1)
    ]
    both = {r["term"]: (r["clean0"] + r["clean1"], r["bad0"] + r["bad1"]) for r in kept}
    model = ToxicityModel(base, _shares(both, base))
    # Bounded by max_terms, as the model itself.
    shared = documents.sparkSession.sparkContext.broadcast([vars(half) for half in halves])

    def scan(batch):
        models = [ToxicityModel.__new__(ToxicityModel) for _ in range(2)]
        for one, state in zip(models, shared.value):
            vars(one).update(state)
        held: list[dict[str, float]] = [{}, {}]
        found = [
            _scan(value, models[1 - half], held[1 - half])
            for value, half in zip(texts_of(batch.column(0)), batch.column(2).to_pylist())
        ]
        return {
            "label": batch.column(1),
            "tokens": pa.array([n for _, n in found], pa.int64()),
            "scores": pa.array([[s for _, _, s in parts] for parts, _ in found], pa.list_(pa.float64())),
        }

    columns = sample.select("_text", "_label", F.col("_half").cast("int"))
    rows = map_rows(columns, scan, "label int, tokens bigint, scores array<double>", "_text").collect()
    clean = [r for r in rows if r["label"] == 0 and r["tokens"]]
    model.calibrate(
        np.array([max(r["scores"], default=0.0) for r in clean]), np.array([float(r["tokens"]) for r in clean])
    )
    evidence = [model.evidence([(0, 0, s) for s in r["scores"]], r["tokens"]) for r in rows]
    if rows:
        model.fit_curve(np.array(evidence), np.array([float(r["label"]) for r in rows]))
    return model


def _shares(counts: dict[str, tuple[int, int]], base: float) -> dict[str, float]:
    """Toxic share of each term. The Dirichlet prior of a term is the share of its stem."""
    shares: dict[str, float] = {}
    for term in sorted(counts, key=lambda t: (not t.endswith("*"), len(t), t)):
        prior, word = base, term.removesuffix("*")
        for n in STEMS:
            if len(word) > n or (len(word) == n and not term.endswith("*")):
                prior = shares.get(f"{word[:n]}*", prior)
        clean, bad = counts[term]
        shares[term] = (bad + PRIOR_WEIGHT * prior) / (clean + bad + PRIOR_WEIGHT)
    return shares


def score(
    documents: DataFrame,
    model: ToxicityModel,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = 0.3,
    keep: list[str] | None = None,
) -> DataFrame:
    """(key, score, predicted, n_passages, passages): passages are (start, end, score) in tokens.

    ``score`` is the probability of the toxic label; ``predicted`` is 1 from ``threshold``
    on. Only passages beyond chance are listed. NULL and empty texts have no passage and the
    score of no evidence. Repeated rows stay; further columns are left out, or those named in ``keep`` go
    first instead of the key alone. The model travels as a broadcast variable: ``learn`` bounds
    its size.
    """
    keep = keep or [key]
    fields = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep]
    at = keep.index(text) if text in keep else len(keep)
    # Plain values: executors need not have this package.
    shared = documents.sparkSession.sparkContext.broadcast(vars(model))
    held: dict[str, float] = {}  # each task has its own copy
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batch):
        model = ToxicityModel.__new__(ToxicityModel)
        vars(model).update(shared.value)
        scores, passages = [], []
        for value in texts_of(batch.column(at)):
            found, n = _scan(value, model, held)
            scores.append(model.probability(model.evidence(found, n)))
            chance = math.log(model.space * n) if n else 0.0
            passages.append(
                [{"start": s, "end": e, "score": v} for s, e, v in found if model.decay * v > chance]
            )
        return {
            **{c: batch.column(i) for i, c in enumerate(keep)},
            "score": pa.array(scores, pa.float64()),
            "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32()),
            "n_passages": pa.array([len(p) for p in passages], pa.int32()),
            "passages": pa.array(passages, pa.list_(passage)),
        }

    fields += ["score double, predicted int, n_passages int"]
    fields += ["passages array<struct<start: int, end: int, score: double>>"]
    columns = keep if text in keep else [*keep, text]
    return map_rows(documents.select(*columns), run, ", ".join(fields), text)
