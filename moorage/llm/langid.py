"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, texts_of
from .components import cut

LONGEST_GRAM = 5
UNDETERMINED = "und"
_WORDS = regex.compile(r"\p{L}+")
REMEMBERED = 200_000


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def grams_of(word: str, size: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


class LanguageModel:
    """Log frequencies per language of words and of character n-grams."""

    def __init__(self, languages: list[str], prior: list[float], tables: list[dict[str, list[float]]]):
        # tables[0] has words, tables[n] has n-grams of n characters.
        self.languages, self.prior, self.tables = languages, prior, tables

    def word(self, word: str) -> list[float]:
        """Log frequencies of a known word, else the mean over its longest known n-grams."""
        found = self.tables[0].get(word)
        if found is not None:
            return found
        for size in range(LONGEST_GRAM, 0, -1):
            table = self.tables[size]
            known = [table[g] for g in grams_of(word, size) if g in table]
            if known:
                return [sum(column) / len(known) for column in zip(*known)]
        return [0.0] * len(self.languages)


def _shares(counts: dict[str, int], most: int) -> dict[str, float]:
    """The part of each language's rows that is taken: equal numbers, what rare ones leave goes on."""
    shares, left = {}, float(most)
    for at, language in enumerate(sorted(counts, key=lambda name: (counts[name], name))):
        taken = min(counts[language], left / (len(counts) - at))
        shares[language], left = taken / counts[language], left - taken
    return shares


def learn(
    documents: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    max_documents: int = 20_000,
    max_terms: int = 60_000,
) -> LanguageModel:
    """Fit on labelled rows. The bounds are ``max_documents`` rows in all, shared out evenly over
    the languages so that rare ones come whole, and ``max_terms`` words and as many n-grams of
    each size, the most frequent ones. Rows are picked by a hash of key and text.
    """
    labelled = documents.select(F.col(key), F.col(text).alias("_text"), F.col(lang).alias("_lang")).dropna()
    counts = {r["_lang"]: r["count"] for r in labelled.groupBy("_lang").count().collect()}
    total = sum(counts.values())
    if not total:
        raise ValueError("no labelled row to learn from")
    limits = {language: int(part * (1 << 30)) for language, part in _shares(counts, max_documents).items()}
    limit = F.coalesce(*[F.when(F.col("_lang") == language, F.lit(n)) for language, n in limits.items()])
    # By key and text: a key on very many rows brings no more than its share of them, equal rows one.
    hashes = [F.xxhash64(F.lit(seed), F.col(key), F.col("_text")).alias(name) for seed, name in ((0, "_hash"), (1, "_twin"))]
    picked = labelled.select("_text", "_lang", *hashes).where(F.pmod("_hash", F.lit(1 << 30)) < limit)
    sample = picked.groupBy("_hash", "_twin", "_lang").agg(F.first("_text").alias("_text"))

    def count(batch):
        words: dict[str, Counter] = {}
        for value, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(language, Counter()).update(words_of(value))
        rows = []
        for language, table in words.items():
            rows += [(language, 0, word, n) for word, n in table.items()]
            for size in range(1, LONGEST_GRAM + 1):
                grams: dict[str, int] = {}
                for word, n in table.items():
                    for gram in grams_of(word, size):
                        grams[gram] = grams.get(gram, 0) + n
                rows += [(language, size, gram, n) for gram, n in grams.items()]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        return {
            name: pa.array(column, kind)
            for name, column, kind in zip(("_lang", "size", "term", "n"), columns, kinds)
        }

    counted = map_rows(sample.select("_text", "_lang"), count, "_lang string, size int, term string, n bigint", "_text")
    # Written once: each table below reads it again.
    terms = cut(counted.groupBy("size", "term", "_lang").agg(F.sum("n").alias("n")))
    totals = {(r["_lang"], r["size"]): r["n"] for r in terms.groupBy("_lang", "size").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(counts)
    per_term = terms.groupBy("size", "term").agg(
        F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("_lang", "n"))).alias("by")
    )
    tables: list[dict[str, list[float]]] = []
    for size in range(LONGEST_GRAM + 1):
        kept = per_term.where(F.col("size") == size).orderBy(F.desc("all"), "term").limit(max_terms).collect()
        every = sum(totals.get((language, size), 0) for language in languages)
        tables.append(
            {
                # A count of one, dealt by the term's overall share, smooths each language.
                r["term"]: [
                    math.log((r["by"].get(language, 0) + r["all"] / every) / (totals.get((language, size), 0) + 1))
                    for language in languages
                ]
                for r in kept
            }
        )
    prior = [math.log(counts[language] / total) for language in languages]
    return LanguageModel(languages, prior, tables)


def predict(
    documents: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, lang_pred, score): the likeliest learned language and its posterior.

    NULL texts and texts without a letter give ``und`` and 0. Equal likelihoods take the
    language that sorts first. Repeated rows stay; further columns are left out. The model
    travels as a broadcast variable: its size is bounded by ``learn``.
    """
    kind = documents.schema[key].dataType.simpleString()
    # Plain values: executors need not have this package.
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.tables))

    held: dict = {}  # each task has its own copy

    def run(batch):
        model = LanguageModel(*shared.value)
        split = [words_of(value) for value in texts_of(batch.column(1))]
        words = set(chain.from_iterable(split))
        new = [word for word in words if word not in held]
        if len(held) + len(new) > REMEMBERED:
            held.clear()
            new = list(words)
        for word in new:
            held[word] = model.word(word)
        width = len(model.languages)
        predicted, scores = [], []
        for words in split:
            if not words:
                predicted.append(UNDETERMINED)
                scores.append(0.0)
                continue
            flat = np.fromiter(chain.from_iterable([held[w] for w in words]), np.float64, width * len(words))
            logs = flat.reshape(-1, width).sum(axis=0) + model.prior
            best = int(logs.argmax())
            predicted.append(model.languages[best])
            scores.append(float(1 / np.exp(logs - logs[best]).sum()))
        return {
            key: batch.column(0),
            "lang_pred": pa.array(predicted, pa.string()),
            "score": pa.array(scores, pa.float64()),
        }

    return map_rows(documents.select(key, text), run, f"{key} {kind}, lang_pred string, score double", text)
