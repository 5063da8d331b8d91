"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position has a vector of radius + 1 bits; each nonzero vector v gives a table whose mask keeps the positions
that have an odd product with v. The positions in which two fingerprints within the radius differ span too few
dimensions to meet every v, so some mask keeps none of them: the pair collides in that table. A bucket is not expanded
into pairs: its members meet at common centres, values one bit away, which is exact for the radius of two.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm._common import stored, with_row_columns
from corvane.llm._graph import components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Shingles that are hashed before their bits are counted.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; each is 1 if it is set in over half the hashes of the shingles, repeats included. No word: zero."""
    words = text.encode().lower().split() if text else []  # of bytes, both know ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    hashed = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle)))), _seeds())
    total, left = np.zeros(BITS, np.int64), len(words) - shingle + 1
    n = left
    while left > 0:
        block = np.fromiter(islice(hashed, BLOCK), np.uint64, min(left, BLOCK))
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        left -= BLOCK
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def _seeds():
    while True:
        yield SEED


def with_fingerprint(docs: DataFrame, text: str, out: str = "fingerprint_bits", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a long; null and blank texts have zero."""

    def prepare():
        return lambda values: [pa.array(np.array([fingerprint(v, shingle) for v in values], np.uint64).view(np.int64))]

    return with_row_columns(docs, text, [T.StructField(out, T.LongType())], prepare)


def masks(radius: int = RADIUS) -> list[int]:
    """2**(radius+1) - 1 masks; positions take the nonzero vectors in turn, so each mask keeps over half of them."""
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if ((i % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def links(prints: DataFrame, fp: str) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints as all pairs within two bits would.

    A fingerprint is sought in each table; those that share a bucket there meet at centres: all values that differ from
    a member in no or one of the bits that the mask drops. Two members within two bits share a centre, and all members
    at a centre (33 at most) are within two bits of each other, so linking each to the smallest loses no link.
    """
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks())]))
    probes = prints.select(F.col(fp).alias("fp")).distinct().select("fp", tables.alias("p")).select("fp", "p.t", "p.key")
    full = probes.groupBy("t", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("t", "key")
    centres: Column = F.lit(None)
    for k, m in enumerate(masks()):
        flips = [0] + [1 << i for i in range(BITS) if not m >> i & 1]
        centres = F.when(F.col("t") == k, F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(x))) for x in flips])).otherwise(centres)
    met = probes.join(full, ["t", "key"]).select("t", "fp", F.explode(centres).alias("centre"))
    groups = met.groupBy("t", "centre").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    return groups.select(F.array_min("members").alias("b"), F.explode("members").alias("a")).where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint_bits, component_id) for each row: the smallest doc_id that is reachable over fingerprints
    that differ in at most two bits. A very long text takes one task's time in proportion to its length.

    Exact copies are one node of the graph, however many rows they have. Rows with a null id get their group's smallest
    id (null if it has none); repeated rows stay; an empty table gives an empty result. Other columns are not carried.
    """
    prints = stored(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle=shingle).select("doc_id", "fingerprint_bits"), "simhash")
    nodes = prints.groupBy("fingerprint_bits").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes, "fingerprint_bits")).withColumnsRenamed({"node": "fingerprint_bits"})
    rooted = nodes.join(found, "fingerprint_bits", "left").select("fingerprint_bits", "least", F.coalesce("root", "fingerprint_bits").alias("root"))
    ids = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")).join(rooted, "root").select("fingerprint_bits", "component_id"), "simhash-ids")
    return prints.join(ids, "fingerprint_bits").select("doc_id", "fingerprint_bits", "component_id")
