"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words in order give overlapping k-grams. Their hashes roll: each word is hashed once, and the hash of a k-gram
comes from the one before by a turn of its bits, taking the word out that it leaves and the one in that it gains. Of each
window of hashes the smallest is kept, the rightmost of equal ones, with its place. Any run of ``k + window - 1`` words
that two texts share puts a common hash into both fingerprints. Words are cut after WORD code points, so a text without white space has k-grams too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm._common import ranged

K, WINDOW, WORD = 5, 4, 12
#: Text bytes of a range of ids, about.
RANGE_BYTES = 8 << 20
#: K-grams that a hash rolls over before it starts anew: a list that grows is copied at each step, so it has to stay short.
ROLL = 64


def words(text: Column) -> Column:
    """Runs other than ASCII white space, in pieces of WORD code points; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\x09-\x0D ]{{1,{WORD}}}"), F.lit(0))


def _turned(bits: Column, by: int) -> Column:
    """64 bits turned to the left."""
    return F.shiftleft(bits, by % 64).bitwiseOR(F.shiftrightunsigned(bits, 64 - by % 64)) if by % 64 else bits


def hashes(word_hashes: Column, k: int = K) -> Column:
    """Hashes of all k-grams in order, from those of the words; fewer words are one k-gram, none gives none.

    The hash of a k-gram is that of its words, each turned by the number of words behind it in the k-gram, exclusively
    or'ed together.
    """
    count = F.least(F.size(word_hashes), F.greatest(F.size(word_hashes) - (k - 1), F.lit(1)))
    word = lambda i: F.coalesce(F.get(word_hashes, i), F.lit(0).cast("long"))

    def rolled(start: Column) -> Column:
        first = _turned(word(start), k - 1)
        for j in range(1, k):
            first = first.bitwiseXOR(_turned(word(start + j), k - 1 - j))
        on = F.sequence(start + 1, F.least(start + ROLL, count) - 1)
        return F.when(F.least(start + ROLL, count) == start + 1, F.array(first)).otherwise(F.aggregate(on, F.array(first), step))

    def step(done: Column, i: Column) -> Column:
        before = F.coalesce(F.element_at(done, -1), F.lit(0).cast("long"))
        return F.array_append(done, _turned(before, 1).bitwiseXOR(_turned(word(i - 1), k)).bitwiseXOR(word(i + (k - 1))))

    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(ROLL))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, rolled))


def winnow(grams: Column, window: int = WINDOW) -> Column:
    """Places, from 0 on, of what is kept: in each window (or all there is, if less) the rightmost least hash."""

    def rightmost(first: Column, i: Column) -> Column:
        hashed = [first] + [F.get(grams, i + j) for j in range(1, window)]
        place = i
        for j in range(1, window):  # places from the right come first; those behind the end are null and never least
            lower = [hashed[j] <= F.coalesce(x, hashed[j]) for x in hashed[:j]]
            above = [F.coalesce(hashed[j] < x, F.lit(True)) for x in hashed[j + 1 :]]
            place = F.when(F.coalesce(_all(lower + above), F.lit(False)), i + j).otherwise(place)
        return place

    count = F.least(F.size(grams), F.greatest(F.size(grams) - (window - 1), F.lit(1)))
    return F.array_distinct(F.transform(F.slice(grams, 1, count), rightmost))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """``df`` with the fingerprint of each whole text: a struct of the kept hashes and their places, both in order.

    A null or empty text has an empty one; equal texts have equal ones; a very long text takes one task's time in
    proportion to its length. Rows are independent; a column named ``out`` is replaced, the others stay. Each step is a
    column of its own, so that none is computed twice.
    """
    df = df.withColumn("__winnow_w", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    df = df.withColumn("__winnow_g", hashes(F.col("__winnow_w"), k)).drop("__winnow_w").withColumn("__winnow_p", winnow(F.col("__winnow_g"), window))
    kept = F.transform("__winnow_p", lambda p: F.get(F.col("__winnow_g"), p))
    return df.withColumn(out, F.struct(kept.alias("hashes"), F.col("__winnow_p").alias("places"))).drop("__winnow_g", "__winnow_p")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all distinct hashes of two fingerprints; two without any are alike."""
    x, y = F.array_distinct(a["hashes"]), F.array_distinct(b["hashes"])
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def with_next(docs: DataFrame, doc_id: str, text: str, range_bytes: int = RANGE_BYTES, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint) for each row, next being the document of the next smaller
    id; after the last comes the first.

    Rows of one id follow each other in order of text; rows without an id come last, in order of the texts' hash, then
    text; a null text is empty; a lone row is its own next; other columns are left out; an empty table gives an empty
    result. Rows are dealt out by ranges of ids, or of hashes, about ``range_bytes`` of text each; the first rows of a
    range are also copied to the end of the range before it, so no range needs another's rows and none holds them all.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known, known_ranges = ranged(rows.where("doc_id IS NOT NULL").withColumn("_id", F.col("doc_id")), "_id", "text", range_bytes, "_range")
    idless = rows.where("doc_id IS NULL").withColumn("_id", F.xxhash64("text"))
    if not idless.isEmpty():
        idless, count = ranged(idless, "_id", "text", range_bytes, "_range")
        if known.isEmpty():
            known_ranges = 0
        rows = idless.unionByName(known.withColumn("_range", F.col("_range") + count))
        count += known_ranges
    else:
        rows, count = known, known_ranges
    rows = rows.withColumn("_id", F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("_id").alias("id")))
    heads = rows.groupBy("_range").agg(F.max("_id").alias("_head"))  # a row for each range; none is empty
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("copy"))
    copy = F.struct(((F.col("_range") + 1) % count).alias("range"), F.lit(1).alias("copy"))
    dealt = rows.join(F.broadcast(heads), "_range").select("doc_id", "text", "_id", F.explode(F.when(F.col("_id") == F.col("_head"), F.array(own, copy)).otherwise(F.array(own))).alias("_to"))
    dealt = dealt.select("doc_id", "text", "_id", "_to.range", "_to.copy").repartition("range")
    order = Window.partitionBy("range").orderBy("copy", F.col("_id").desc(), "text")
    found = with_fingerprint(dealt, "text", "fingerprint", k, window)
    found = found.select("*", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint"))
    return found.where("copy = 0").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
