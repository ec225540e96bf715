"""Toxicity by multiple-instance learning: labels are on documents, scores on sentences.

A sentence's log-odds is a bias plus the weights of its words; a word's weight is the sum over itself and its beginnings,
hashed into FEATURES slots. A document is toxic if any sentence is: its probability is the noisy-or 1 - prod(1 - p).
Weights are trained from document labels through that noisy-or, then sentences are scored for themselves, which locates
the offending ones.

Training takes at most SAMPLE documents of each class, chosen by a hash of doc_id, with weights that restore the classes'
shares, in one task (the bound is what makes that task fit). Scoring reads every whole text, needs no shuffle, and carries
the model, whose size is fixed, to the tasks.

Defined cases: a null, empty or blank text has no sentences and scores 0. Labels that are null, or of documents that don't
exist, are left out; of several labels for one document the largest counts. Without labels, or with one class alone, the
model has no weights and every document scores near the share of toxic labels at most. Repeated rows are scored each for
itself. Rows with a null doc_id are scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FEATURES = 1 << 18
SAMPLE = 3000
#: SPARE pulls weights to zero, which keeps them to the words that tell the classes apart.
EPOCHS, RATE, SPARE = 160, 0.05, 3e-4
#: Features of fewer documents get no weight.
MIN_DOCUMENTS = 8
#: The log-odds of a probability of 0.3.
OFFENDING = math.log(0.3 / 0.7)
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def word_features(word: str) -> list[int]:
    parts = {f"={word}", *(word[:n] for n in (4, 5, 6, 7) if len(word) >= n)}
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % FEATURES for p in sorted(parts)]


@dataclass
class Model:
    weights: np.ndarray
    bias: float


class Scorer:
    """Sentence probabilities; words' weights are remembered, up to a bound."""

    REMEMBERED = 300_000

    def __init__(self, model: Model) -> None:
        weights = model.weights
        bound = self.REMEMBERED

        class Known(dict):
            def __missing__(self, word: str) -> float:
                if len(self) >= bound:
                    self.clear()
                self[word] = out = float(sum(weights[f] for f in word_features(word)))
                return out

        self.bias, self.known = model.bias, Known()

    def sentences(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's score, and (start, length, probability) of its offending sentences."""
        total, found, weight = 0.0, [], self.known.__getitem__
        for m in _SENTENCE.finditer(text):
            words = _WORD.findall(m[0].lower())
            if words:
                z = max(-30.0, min(30.0, self.bias + sum(map(weight, words))))
                total += math.log1p(math.exp(z))
                if z >= OFFENDING:
                    found.append((m.start(), len(m[0]), 1 / (1 + math.exp(-z))))
        return -math.expm1(-total), found


def fit(texts: list[str], labels: np.ndarray, doc_weights: np.ndarray) -> Model:
    """Adam on the log loss of the noisy-or. Words are shared: features are summed once per distinct word."""
    vocabulary: dict[str, int] = {}
    words, sentence_at, doc_of = [], [], []
    for d, text in enumerate(texts):
        for s in _SENTENCE.findall(text.lower()):
            found = _WORD.findall(s)
            if found:
                sentence_at.append(len(words))
                doc_of.append(d)
                words += [vocabulary.setdefault(w, len(vocabulary)) for w in found]
    share = float(doc_weights[labels == 1].sum() / max(doc_weights.sum(), 1e-9))
    bias = math.log(max(share, 1e-4) * len(texts) / max(1, len(doc_of)) + 1e-9)
    if not doc_of or len(set(labels.tolist())) < 2:
        return Model(np.zeros(FEATURES, np.float32), bias if doc_of else -10.0)
    slots = [word_features(w) for w in vocabulary]
    slot = np.concatenate([np.array(x) for x in slots])
    slot_at = np.concatenate([[0], np.cumsum([len(x) for x in slots])[:-1]])
    word_of_slot = np.repeat(np.arange(len(slots)), [len(x) for x in slots])
    words, sentence_at, doc_of = np.array(words), np.array(sentence_at), np.array(doc_of)
    sentence_of = np.repeat(np.arange(len(sentence_at)), np.diff([*sentence_at, len(words)]))
    n, y, mass = len(texts), labels.astype(float), doc_weights / doc_weights.sum()
    pairs = np.unique(words * n + doc_of[sentence_of])  # a word and a document that has it
    of_word = np.bincount(pairs // n, minlength=len(slots))
    rare = np.bincount(slot, of_word[word_of_slot], FEATURES) < MIN_DOCUMENTS
    theta, m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    theta[-1] = bias
    for step in range(1, EPOCHS + 1):
        word_weight = np.add.reduceat(theta[slot], slot_at)
        z = np.clip(theta[-1] + np.add.reduceat(word_weight[words], sentence_at), -30, 30)
        total = np.maximum(np.bincount(doc_of, np.log1p(np.exp(z)), n), 1e-9)
        outer = mass * np.where(y == 1, -1 / np.expm1(total), 1.0)
        g = outer[doc_of] / (1 + np.exp(-z))
        by_word = np.bincount(words, g[sentence_of], len(slots))
        grad = np.append(np.bincount(slot, by_word[word_of_slot], FEATURES), g.sum())
        grad[:-1] += SPARE * np.sign(theta[:-1])
        grad[:-1][rare] = 0.0
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    return Model(theta[:-1].astype(np.float32), float(theta[-1]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: doc_id, toxic; what is held out must have been taken away by the caller."""
    given = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(1)), "doc_id"]
    chosen = None
    counts = {r.toxic: r.n for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    for kind in (0, 1):
        some = given.filter(F.col("toxic") == kind).orderBy(*order).limit(sample).withColumn("mass", F.lit(max(1.0, counts.get(kind, 0) / sample)))
        chosen = some if chosen is None else chosen.unionByName(some)
    bag = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select(F.lit(0).alias("bag"), "doc_id", "text", "toxic", "mass")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
        model = fit(rows.text.to_list(), rows.toxic.to_numpy(), rows.mass.to_numpy())
        return pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    got = bag.groupBy("bag").applyInPandas(learn, "weights binary, bias double").first()
    return Model(np.frombuffer(got.weights, np.float32), got.bias) if got else Model(np.zeros(FEATURES, np.float32), -10.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and offending: the sentences of probability 0.3 or more, as start, length and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for text in batch["text"]:
                s, found = scorer.sentences(text.as_py() or "")
                scores.append(s)
                spans.append([{"start": a, "length": n, "score": p} for a, n, p in found])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "offending"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, offending array<struct<start:int,length:int,score:double>>")
