"""Language identification by multilingual mixture inference.

Each word of a text has a likelihood under each language: that of its letter trigrams (with word ends).  Expectation
maximisation over the words gives the languages' proportions in the text; it is repeated for the one, two, ... most
likely languages until the likelihood less a penalty (PENALTY x log(words) / 2 for each further language) no longer
rises, whatever their number; the last set that raised it is the text's language set.  Its main language is the
prediction (the first in the order of names if several are equally likely), its proportion over all languages the score.

The model is a table of TABLE hashed trigrams a language.  It is fitted on at most TRAIN_DOCS labelled documents a
language (those with the smallest hash of their text among those of at most TRAIN_CHARS characters): a bound that does
not follow the corpus, so that the sample fits the driver.  Each language is counted first, and only texts whose hash is
below a threshold that leaves about SPARE times as many as wanted are shuffled to pick the smallest.  Prediction reads whole texts in pieces of fixed size, and
uses nothing but the text.

Cases.  A null text, or one without letters, is `und` with score 0; so is every text if no row has a label.  Null
labels are not learned.  Null and repeated doc_ids and repeated rows are rows like any other; a null doc_id is not held
out.  Empty tables give empty results; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, table, unpacked

TABLE = 1 << 16
TRAIN_DOCS = 400
TRAIN_CHARS = 20_000
SPARE = 2.0
ROUNDS = 12
PENALTY = 2.0
PIECE = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, else 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _trigrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram of each letter, place of each letter) in code points where 0 is no letter."""
    at = np.flatnonzero(points)
    padded = np.concatenate(([0], points, [0])).astype(np.uint32)
    h = padded[at] * np.uint32(2654435761) ^ padded[at + 1] * np.uint32(2246822519) ^ padded[at + 2] * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return (h >> np.uint32(16)).astype(np.int64), at


def word_scores(text: str, model: np.ndarray) -> np.ndarray:
    """(words, languages): log-likelihood of each word.  A word longer than a piece counts as several."""
    found = []
    for points in _pieces(text):
        grams, at = _trigrams(points)
        if len(at):
            starts = np.concatenate(([0], np.flatnonzero(np.diff(at) > 1) + 1))
            found.append(np.add.reduceat(model[grams], starts, axis=0))
    return np.concatenate(found) if found else np.empty((0, model.shape[1]), dtype=np.float32)


def _pieces(text: str) -> Iterator[np.ndarray]:
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        points = _letters()[np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if end < len(text):
            gaps = np.flatnonzero(points == 0)
            if len(gaps):
                points = points[: gaps[-1] + 1]
        yield points
        at += len(points)


def fit(samples: dict[str, list[str]]) -> tuple[list[str], np.ndarray]:
    """(languages in order, (TABLE, languages) log-probabilities)."""
    names = sorted(samples)
    model = np.empty((TABLE, len(names)), dtype=np.float32)
    for j, name in enumerate(names):
        counts = np.zeros(TABLE)
        for text in samples[name]:
            for points in _pieces(text):
                counts += np.bincount(_trigrams(points)[0], minlength=TABLE)
        model[:, j] = np.log((counts + 0.1) / (counts.sum() + 0.1 * TABLE))
    return names, model


def _mixture(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for several texts at once.  scores: exp(log-likelihood - word's best); allowed: (texts, languages).
    Returns proportions (texts, languages) and log-likelihoods relative to the words' bests."""
    weights = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        joint = scores * np.repeat(weights, counts, axis=0)
        joint /= joint.sum(1, keepdims=True)
        weights = np.add.reduceat(joint, starts, axis=0) / counts[:, None]
    total = np.log((scores * np.repeat(weights, counts, axis=0)).sum(1))
    return weights, np.add.reduceat(total, starts)


def infer(words: list[np.ndarray], languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text (its word_scores): index of the main language (-1: none), its proportion, size of the language set."""
    main, share, size = np.full(len(words), -1), np.zeros(len(words)), np.zeros(len(words), dtype=int)
    some = [i for i, w in enumerate(words) if len(w)]
    if not some or not languages:
        return main, share, size
    counts = np.array([len(words[i]) for i in some])
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    logs = np.concatenate([words[i] for i in some])
    scores = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -50)).astype(np.float64)
    weights, _ = _mixture(scores, starts, counts, np.ones((len(some), languages)))
    order = np.argsort(-weights, axis=1, kind="stable")
    best, chosen = np.full(len(some), -np.inf), np.zeros(len(some), dtype=int)
    rank = np.argsort(order, axis=1, kind="stable")
    top = np.zeros(len(some), dtype=int)
    left = np.arange(len(some))  # texts whose last set was better than the one before
    for k in range(1, languages + 1):
        words_of = scores if len(left) == len(some) else scores[np.repeat(np.isin(np.arange(len(some)), left), counts)]
        n = counts[left]
        part, likelihood = _mixture(words_of, np.concatenate(([0], np.cumsum(n)[:-1])), n, (rank[left] < k).astype(np.float64))
        likelihood = likelihood - PENALTY * 0.5 * (k - 1) * np.log(n)
        better = likelihood > best[left]
        left, part = left[better], part[better]
        best[left], chosen[left], top[left] = likelihood[better], k, part.argmax(1)
        if not len(left):
            break
    main[some], share[some], size[some] = top, weights[np.arange(len(some)), top], chosen
    return main, share, size


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """A model from the labelled rows that are not held out; see the bounds above."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & (F.char_length("text") <= TRAIN_CHARS))
    counts = dict(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a language
    if not counts:
        return fit({})
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, SPARE * TRAIN_DOCS / n))])
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < share[F.col("lang")] * float(1 << 40))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 40)), "text")
    rows = rows.select("lang", "text").withColumn("k", F.row_number().over(order)).where(F.col("k") <= TRAIN_DOCS)
    samples: dict[str, list[str]] = {}
    for lang, text, _ in rows.collect():  # TRAIN_DOCS rows a language
        samples.setdefault(lang, []).append(text)
    return fit({k: sorted(v) for k, v in samples.items()})


def predictor(names: list[str], model: np.ndarray):
    """A column function: text -> struct(lang_pred, score, n_langs)."""

    @F.pandas_udf("lang_pred string, score double, n_langs int")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out, held, size = [], [], 0

            def flush(held):
                main, share, sets = infer(held, len(names))
                return pd.DataFrame({"lang_pred": [names[m] if m >= 0 else UNKNOWN for m in main], "score": share, "n_langs": sets.astype("int32")})

            for text in texts:
                held.append(word_scores(text, model) if text and names else np.empty((0, len(names)), dtype=np.float32))
                size += len(held[-1])
                if size > 300_000:
                    out.append(flush(held))
                    held, size = [], 0
            out.append(flush(held))
            yield pd.concat(out, ignore_index=True)

    return predict


def predictions(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_langs."""
    predict = predictor(*learn(docs))
    found = docs.select("doc_id", predict("text").alias("p"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", F.least(F.col("p.score"), F.lit(1.0)).alias("score"), "p.n_langs")


def keep_identified(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """docs whose text has a language, one that makes up at least `least_score` of it; all columns.  If no row has a label
    there is nothing to learn languages from, and all texts with a letter stay."""
    names, model = learn(docs)
    if not names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    predict = predictor(names, model)
    rows = packed(docs).withColumn("p", predict("row.text"))
    return unpacked(rows.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least_score)).select("row"))


def op5_language_mixture(spark, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "documents")).drop("n_langs")
