"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each permuted
(rotated) by its place; a document bundles (adds) the vectors of its n-grams. A language's prototype bundles documents
of that language; what all prototypes have in common is taken off, and a document goes to the prototype of the largest
cosine.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm._common import released, slices, small_batches, with_row_columns

DIMENSIONS, NGRAM, SEED = 1024, 3, 20240229
#: Labelled documents that prototypes are fitted on, about.
FIT_DOCS = 20_000
#: Tasks that bundle them.
FIT_TASKS = 8
#: N-gram vectors that a process remembers.
MEMORY = 16_384
#: Sharpness of the score: a share of exp(SHARP * cosine).
SHARP = 16.0
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0 (a gap)."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


@functools.lru_cache(maxsize=65_536)
def _vector(code: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, DIMENSIONS).astype(np.float32) * 2 - 1


class Bundler:
    def __init__(self):
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((MEMORY, DIMENSIONS), np.float32)

    def ngrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """The distinct n-grams over letters and single gaps, and their counts; None without a letter."""
        if not text:
            return None
        codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
        codes = np.concatenate(([0], codes, [0])).astype(np.uint64)
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
        if len(codes) < NGRAM:
            return None
        packed = functools.reduce(lambda a, i: (a << np.uint64(21)) | codes[i : len(codes) - NGRAM + 1 + i], range(1, NGRAM), codes[: len(codes) - NGRAM + 1])
        return np.unique(packed, return_counts=True)

    def _row(self, packed: int) -> int:
        if len(self.rows) >= MEMORY:
            self.rows.clear()
        codes = [packed >> 21 * i & 0x1FFFFF for i in range(NGRAM)]
        k = self.rows[packed] = len(self.rows)
        self.matrix[k] = functools.reduce(np.multiply, [np.roll(_vector(c), i) for i, c in enumerate(codes)])
        return k

    def bundle(self, text: str | None) -> np.ndarray | None:
        found = self.ngrams(text)
        if found is None:
            return None
        total = np.zeros(DIMENSIONS, np.float32)
        for lo in range(0, len(found[0]), MEMORY // 4):  # a block's rows are looked up twice if the memory starts anew
            keys, rows = found[0][lo : lo + MEMORY // 4].tolist(), self.rows
            if len(rows) + len(keys) > MEMORY:
                rows.clear()
            index = [rows[k] if k in rows else self._row(k) for k in keys]
            total += found[1][lo : lo + MEMORY // 4].astype(np.float32) @ self.matrix[index]
        return total


def fit(docs: DataFrame, text: str, lang: str, key: str, bound: int = FIT_DOCS) -> dict[str, np.ndarray]:
    """Prototypes by language, from about ``bound`` of the rows whose ``lang`` is not null, chosen by a hash of ``key``.

    Each document weighs the same. Tasks add up the vectors; the driver gets FIT_TASKS vectors a language.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull())
    count = labelled.count()
    if not count:
        return {}
    share = min(1.0, bound / count)
    chosen = labelled.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    chosen = chosen.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")).repartition(FIT_TASKS, "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(), {}
        for batch in batches:
            for part in slices(batch, "text"):
                for t, name in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    if (v := bundler.bundle(t)) is not None:
                        sums[name] = sums.get(name, 0) + v / (np.linalg.norm(v) or 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float32()))], names=["lang", "sum"])
        del bundler
        released()

    small_batches(docs.sparkSession)
    totals: dict[str, np.ndarray] = {}
    for row in chosen.mapInArrow(run, "lang string, sum array<float>").collect():
        totals[row["lang"]] = totals.get(row["lang"], 0) + np.array(row["sum"], np.float64)
    unit = {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(totals.items())}
    middle = np.mean(list(unit.values()), axis=0) if len(unit) > 1 else 0
    return {k: ((v - middle) / (np.linalg.norm(v - middle) or 1)).astype(np.float32) for k, v in unit.items()}


def predict(docs: DataFrame, text: str, prototypes: dict[str, np.ndarray], out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of each whole text and a score from 0 to 1 (its share among all languages).

    A null text, one without a letter, and any text where no prototype was learnt is ``und`` with score 0. Of equal
    cosines the language that sorts first wins. Rows are independent; columns named as the new ones are replaced.
    """
    names, matrix = list(prototypes), np.array([*prototypes.values()], np.float32).reshape(len(prototypes), DIMENSIONS)

    def prepare():
        bundler = Bundler()

        def apply(values: list) -> list:
            langs, scores = [], []
            for v in values:
                bundle = bundler.bundle(v) if names else None
                if bundle is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosine = matrix @ bundle / (np.linalg.norm(bundle) or 1)
                k = int(np.argmax(cosine))
                langs.append(names[k])
                scores.append(float(1 / np.exp(SHARP * (cosine - cosine[k])).sum()))
            return [langs, scores]

        return apply

    return with_row_columns(docs, text, [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())], prepare)
