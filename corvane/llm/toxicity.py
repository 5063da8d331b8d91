"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in the hashed features of its distinct words (the word and its
first letters), whose weights aren't negative: no word makes up for another. A document is toxic unless each of its
sentences is harmless (noisy-or). Only documents have labels;
their likelihood's gradient reaches sentences in proportion to what each adds, so the model finds out by itself which
sentences offend, and can point at them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm._common import slices, with_row_columns

BITS = 20
#: First letters of a word that are features beside it.
PREFIXES = (4, 5)
#: Labelled documents, whatever their length, that the model is fitted on, about.
FIT_DOCS = 6_000
#: The bias to start with: a sentence without a telling word is harmless but for one in 20,000, so long texts stay clean.
START = -10.0
STEPS, RATE, DECAY = 140, 2.5, 1e-6
#: Squared slope that each weight starts with: words of a few documents move little, those of many soon.
RESERVE = 400.0
#: Sentences that a feature must be in to be learnt.
RARE = 5
#: Words that a process remembers.
MEMORY = 500_000

#: A sentence, or 400 code points of one.
_SENTENCE = re.compile(r"[^.!?\n]{1,400}")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Places of a word and its beginnings; a beginning that is the word counts as both."""
    return [xxhash.xxh64_intdigest(f"{n}:{word[:n]}") >> (64 - BITS) for n in PREFIXES] + [xxhash.xxh64_intdigest(word) >> (64 - BITS)]


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}

    def _sum(self, sentence: str) -> float:
        known, total = self.known, self.bias
        for word in set(_WORD.findall(sentence.lower())):
            value = known.get(word)
            if value is None:
                if len(known) >= MEMORY:
                    known.clear()
                value = known[word] = float(self.weights[features(word)].sum())
            total += value
        return total

    def sentences(self, text: str | None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """The spans of all sentences, and how likely each is toxic; a text without any is one empty sentence."""
        found = [(m.start(), m.end(), m[0]) for m in _SENTENCE.finditer(text or "")] or [(0, 0, "")]
        return [(a, b) for a, b, _ in found], 1 / (1 + np.exp(-np.array([self._sum(s) for _, _, s in found])))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def train(feats: np.ndarray, words_of: np.ndarray, sentences_of: np.ndarray, labels: np.ndarray) -> Model:
    """Full-batch ascent of the labels' likelihood. ``words_of``: features of each sentence, ``sentences_of``: sentences of each document."""
    weights, bias = np.zeros(1 << BITS), START
    squares, bias_square = np.full(1 << BITS, RESERVE), RESERVE
    first = np.concatenate(([0], np.cumsum(sentences_of)[:-1]))
    own = np.repeat(np.arange(len(words_of)), words_of)
    doc = np.repeat(np.arange(len(labels)), sentences_of)
    often = np.bincount(feats, minlength=1 << BITS)[feats] >= RARE  # the others can't be told from chance
    feats, own = feats[often], own[often]
    for _ in range(STEPS if len(labels) else 0):
        z = bias + np.bincount(own, weights[feats], len(words_of))
        p = 1 / (1 + np.exp(-z))
        harmless = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), first)
        toxic = -np.expm1(harmless)
        pull = np.where(labels == 1, np.exp(harmless) / np.maximum(toxic, 1e-12), -1.0)[doc] * p
        slope = np.bincount(feats, pull[own], 1 << BITS) - DECAY * len(labels) * weights
        squares += slope * slope
        weights = np.maximum(weights + RATE * slope / np.sqrt(squares), 0)
        bias_square += pull.sum() ** 2
        bias += RATE * pull.sum() / np.sqrt(bias_square)
    return Model(weights.astype(np.float32), float(bias))


def bag(text: str) -> tuple[list[int], list[int]]:
    """The features of all sentences, and how many each has."""
    found = [[f for w in sorted(set(_WORD.findall(m[0].lower()))) for f in features(w)] for m in _SENTENCE.finditer(text)] or [[]]
    return [f for s in found for f in s], [len(s) for s in found]


def fit(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, label: str, among: Callable[[str], Column] | None = None, bound: int = FIT_DOCS) -> Model:
    """A model of about ``bound`` labelled documents, whole, chosen by a hash of the id.

    ``among`` restricts ids (training rows). Null ids and labels are left out; of several labels of an id the largest
    holds; of several texts of an id each is one document; a null text is an empty one. Without a labelled document
    every score is that of the first bias. The driver gets 4 bytes a feature of the sample, the only thing that is
    bounded: very long texts make it large, so ``bound`` is to be lowered for them.
    """
    chosen = labels.select(F.col(label_id).alias("id"), F.col(label).alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    if among is not None:
        chosen = chosen.where(among("id"))
    chosen = chosen.groupBy("id").agg(F.max("y").alias("y"))
    share = min(1.0, bound / max(1, chosen.count()))
    chosen = chosen.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                bags = [bag(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in bags], pa.list_(pa.int32())), pa.array([x[1] for x in bags], pa.list_(pa.int32())), part.column(2)], names=["id", "feats", "sizes", "y"])

    sample = texts.join(chosen, "id").select(F.col("id").cast("string"), "text", F.col("y").cast("int"))
    table = sample.mapInArrow(run, "id string, feats array<int>, sizes array<int>, y int").toArrow().sort_by("id")
    flat = lambda c: table[c].combine_chunks().flatten().to_numpy() if table.num_rows else np.zeros(0, np.int32)
    return train(flat("feats"), flat("sizes"), np.array([len(x) for x in table["sizes"].to_pylist()], np.int64), table["y"].to_numpy())


def score(docs: DataFrame, text: str, model: Model, above: float = 0.5) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) of each whole text and ``offending``: spans and scores of sentences ``above``.

    Null and empty texts have the score of an empty sentence; a very long one takes one task's time in proportion to its
    length. Rows are independent, repeated ones score alike; columns named as the new ones are replaced, the others stay;
    an empty table gives an empty one.
    """
    weights, bias = model.weights, model.bias
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])

    def prepare():
        own = Model(weights, bias)

        def apply(values: list) -> list:
            scores, offending = [], []
            for v in values:
                spans, p = own.sentences(v)
                scores.append(noisy_or(p))
                offending.append([{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p > above)])
            return [scores, offending]

        return apply

    return with_row_columns(docs, text, [T.StructField("toxicity", T.DoubleType()), T.StructField("offending", T.ArrayType(span))], prepare)
