"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The symbols are words, the patterns are windows of consecutive benchmark words. Patterns of one length share a table:
a block of two words that ends no pattern soon lets the search skip ahead, a block that ends one selects a bucket by its
hash, the first word selects the test strings in it, and a direct comparison confirms each occurrence.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm._common import released, slices, small_batches

#: Words of a window.
WINDOW = 10
#: Words of a block of the shift table.
BLOCK = 2
#: Benchmark text that one pass over the documents searches for; more of it takes more passes.
PASS_BYTES = 8 << 20

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEEP else 32 for c in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (in lower case), digits and other than ASCII characters; a null text has none."""
    return text.encode().translate(_WORDS).split() if text else []


class WuManber:
    """Finds windows of ``size`` words of the items; an item of fewer words, but not none, is one window."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], size: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            found = words(text)
            for i in range(max(1, len(found) - size + 1) if found else 0):
                owners[tuple(found[i : i + size])].update([] if item is None else [item])
        by_length = defaultdict(list)
        for pattern, ids in owners.items():
            by_length[len(pattern)].append((pattern, sorted(ids)))
        self.tables = [self._table(n, patterns) for n, patterns in sorted(by_length.items())]

    @staticmethod
    def _table(n: int, patterns: list) -> tuple:
        block = min(BLOCK, n)
        shift: dict[tuple[bytes, ...], int] = {}
        buckets: dict[tuple[bytes, ...], dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for pattern, ids in patterns:
            for end in range(block, n + 1):
                key = pattern[end - block : end]
                shift[key] = min(shift.get(key, n), n - end)
            buckets[pattern[n - block :]][pattern[0]].append((list(pattern), ids))
        return n, block, shift, {k: dict(v) for k, v in buckets.items()}

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (start, end), merged and in order, and the items that have an occurring window."""
        hits, ids = [], set()
        for n, block, shift, buckets in self.tables:
            far, end, last = n - block + 1, n, len(text)
            while end <= last:
                key = (text[end - 2], text[end - 1]) if block == 2 else (text[end - 1],)
                if jump := shift.get(key, far):
                    end += jump
                    continue
                start = end - n
                for pattern, owners in buckets[key].get(text[start], ()):
                    if text[start:end] == pattern:
                        hits.append((start, end))
                        ids.update(owners)
                end += 1
        return merged(hits), ids


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def decontaminate(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with ``n_words`` (long), ``hit_spans`` (array of start and end word) and ``hit_items`` (array of item ids as text).

    The benchmark is taken in blocks of ``pass_bytes`` of its text at most on average; each block is sent to the
    executors and searched for in one pass over all documents, without a shuffle. Rows are independent. A null text has
    no words; null item ids occur as spans but not as items; repeated ids count once; an empty benchmark hits nothing.
    Columns of ``docs`` named as the new ones are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = items.agg(F.sum(F.octet_length(F.col(item_text)))).first()[0] or 0
    passes = max(1, math.ceil(size / pass_bytes))
    new = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    names = {f.name for f in new}
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    pairs = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    for k in range(passes):
        rows = pairs.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k).collect()
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast([(r.id, r.text) for r in rows]), text, window), T.StructType([f for f in out.schema if f.name not in names] + new))
    return out


def _pass(items, text: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = WuManber(items.value, window)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch, text):
                column = dict(zip(part.schema.names, part.columns))
                before = [column.pop(c).to_pylist() if c in column else None for c in ("n_words", "hit_spans", "hit_items")]
                counts, spans, ids = [], [], []
                for i, value in enumerate(column[text].to_pylist()):
                    found = words(value)
                    hits, owners = finder.search(found)
                    if before[1]:
                        hits = merged(hits + [(s["start"], s["end"]) for s in before[1][i]])
                        owners.update(before[2][i])
                    counts.append(len(found))
                    spans.append([{"start": a, "end": b} for a, b in hits])
                    ids.append(sorted(owners))
                arrays = [*column.values(), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*column, "n_words", "hit_spans", "hit_items"])
        del finder
        released()

    return run
