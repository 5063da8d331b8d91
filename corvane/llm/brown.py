"""Language-model scoring with Brown class-based bigrams.

The most frequent words are put into classes by exchange: word after word moves to the class that makes the training
bigrams likeliest. Every other word that occurs at least twice then joins the class in which it gains most, judged by
its counts before and after each class, which are gathered word by word. Words that occur once belong to classes by
their shape, as do the unseen ones they stand for. A text's probability is the product, over its words and an end, of
the transition from class to class and the emission of the word by its class; both are smoothed, and each class of
shapes keeps a share for unseen words.

All counts cover all training documents. Classes and emissions of the KNOWN most frequent words go to the executors,
those of other words are joined.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._common import released, slices, small_batches, stored

#: Words that are clustered by exchange before all others join their classes, and classes for them.
SEEDS, CLASSES, ROUNDS = 1_000, 64, 6
#: How often a word has to occur to be put into a class; those that occur once stand for the unseen.
LEAST = 2
#: Words of WORD_BYTES at most whose counts are sent to the executors.
KNOWN, WORD_BYTES = 300_000, 64
#: Distinct words that a task tells apart before it passes their counts on.
HELD = 200_000
#: Words (of so many bytes at most) or contexts that a task holds before it passes their counts on; rows that are judged at a time, and words whose gains are held.
EVENTS, HELD_BYTES, ROWS, WORDS = 1 << 22, 1 << 24, 1 << 12, 1 << 8
#: Weight of a class's overall frequency in each transition.
PRIOR = 8.0

#: Classes by shape: 0 has a digit, 1 no letter, then by end, alphabet and length.
SHAPES = 14
_NO_LETTER = bytes(c for c in range(128) if not (97 <= c <= 122 or 65 <= c <= 90))
_MARKS = np.array([48 <= c <= 57 or 2 * (97 <= c <= 122 or 65 <= c <= 90) or 4 * (c > 127) for c in range(256)], np.uint8)


def words(text: str | None) -> list[bytes]:
    """Runs other than ASCII white space, ASCII letters in lower case."""
    return text.encode().lower().split() if text else []


def shape(word: bytes) -> int:
    if len(word.translate(None, b"0123456789")) < len(word):
        return 0
    if not word.translate(None, _NO_LETTER):
        return 1
    last = word[-1]
    return 2 + 6 * (last < 128 and not 97 <= last <= 122) + 3 * (not word.isascii()) + (len(word) > 4) + (len(word) > 9)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words`` of all texts, one text's behind the other's, and how many each text has; without a Python value for each."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = found.flatten()
    there = pc.greater(pc.binary_length(flat), 0)  # white space at an end of the text has an empty word beyond it
    before = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))
    ends = found.offsets.to_numpy()
    return flat.filter(there), np.diff(before[ends - ends[0]])


def shapes(found: pa.Array) -> np.ndarray:
    """``shape`` of each word."""
    if not len(found):
        return np.zeros(0, np.int64)
    _, offsets, data = found.buffers()
    ends = np.frombuffer(offsets, np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    marks = np.bitwise_or.reduceat(_MARKS[raw], ends[:-1] - ends[0])
    last, size = raw[ends[1:] - ends[0] - 1], np.diff(ends)
    out = 2 + 6 * ((last < 128) & ((last < 97) | (last > 122))) + 3 * (marks & 4 > 0) + (size > 4) + (size > 9)
    return np.where(marks & 1, 0, np.where(marks & 6, out, 1))


def codes(found: pa.Array, places: dict[bytes, int]) -> np.ndarray:
    """Of each word its place, or the number of places plus its shape. Distinct words are looked up once."""
    found = found.dictionary_encode()
    own = found.dictionary
    of = np.fromiter(map(places.get, own.cast(pa.binary()).to_numpy(zero_copy_only=False), itertools.repeat(-1)), np.int32, len(own))
    of = np.where(of < 0, len(places) + shapes(own), of).astype(np.int32)
    return of[found.indices.to_numpy()]


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n): how often each word occurs in all documents. Tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def out() -> pa.RecordBatch:
            counts = pc.value_counts(pa.chunked_array(held, pa.string()))
            held.clear()
            return pa.RecordBatch.from_arrays(counts.flatten(), names=["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(split(part.column(0))[0])
                if sum(map(len, held)) > EVENTS or sum(h.nbytes for h in held) > HELD_BYTES:
                    yield out()
        yield out()
        released()

    small_batches(docs.sparkSession)
    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def encoded(docs: DataFrame, text: str, known: list[bytes]) -> DataFrame:
    """(codes, rare) of each text: a word's place among ``known`` or their number plus its shape, and the words of the
    latter kind in their order."""
    names = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = dict(zip(names.value, itertools.count()))
        for batch in batches:
            for part in slices(batch, "text"):
                flat, sizes = split(part.column(0))
                line, ends = codes(flat, places), _ends(sizes)
                unknown = line >= len(places)
                lines = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(line)])
                rare = pa.ListArray.from_arrays(pa.array(_ends(unknown)[ends], pa.int32()), flat.filter(pa.array(unknown)))
                yield pa.RecordBatch.from_arrays([lines, rare], names=["codes", "rare"])
        released()

    small_batches(docs.sparkSession)
    return docs.select(F.col(text).alias("text")).mapInArrow(run, "codes binary, rare array<string>")


def _ends(sizes: np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin, and the end."""
    return np.concatenate(([0], np.cumsum(sizes)))


def _line(part: pa.RecordBatch, edge: int) -> np.ndarray:
    """The codes of all texts with an edge before, between and after them."""
    edges = np.int32(edge).tobytes()
    return np.frombuffer(edges + edges.join(part.column(part.schema.get_field_index("codes")).to_pylist()) + edges, np.int32)


def count_pairs(coded: DataFrame, symbols: np.ndarray, size: int) -> np.ndarray:
    """Bigrams of symbols, which ``symbols`` has for each code, the edge last; pairs with a negative symbol are left out.
    The driver gets a count for each pair of symbols at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for part in slices(batch, "codes"):
                line = symbols[_line(part, len(symbols) - 1)].astype(np.int64)
                pair = (line[:-1] * size + line[1:])[(line[:-1] >= 0) & (line[1:] >= 0)]
                at, n = np.unique(pair, return_counts=True)
                total[at] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["pair", "n"])

    return _matrix(coded.select("codes").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), size)


def _matrix(pairs: DataFrame, size: int) -> np.ndarray:
    rows = pairs.toArrow()
    out = np.zeros(size * size, np.float64)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def contexts(coded: DataFrame, known: list[bytes], seeds: int, symbols: np.ndarray, size: int) -> DataFrame:
    """(word, counts) of all words but the seeds: how often each symbol follows, goes before (plus ``size``), or the word
    follows itself (2 * ``size``); n << 16 | context. Tasks count before anything is shuffled; a word may have several rows."""
    names, edge, width = coded.sparkSession.sparkContext.broadcast([w.decode() for w in known]), len(symbols) - 1, 2 * size + 1
    first = len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local: dict[str, int] = {}
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            first_at = np.flatnonzero(np.diff(keys, prepend=-1))
            n = np.diff(first_at, append=len(keys))
            word, context = np.divmod(keys[first_at], width)
            del keys, first_at
            start = np.flatnonzero(np.diff(word, prepend=-1))
            others = list(local)
            texts = [names.value[i] if i < first else others[i - edge - 1] for i in word[start].tolist()]
            data = n.astype(np.uint64) << np.uint64(16) | context.astype(np.uint64)
            ends = (np.append(start, len(word)) * 8).astype(np.int32)
            local.clear()
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data)])], names=["word", "counts"])

        for batch in batches:
            for part in slices(batch, "codes"):
                line = _line(part, edge).astype(np.int64)
                symbol = symbols[line]
                rare = part.column(part.schema.get_field_index("rare")).flatten().to_pylist()
                line[(line >= first) & (line < edge)] = [edge + 1 + local.setdefault(w, len(local)) for w in rare]
                at = np.flatnonzero((line >= seeds) & (line != edge))
                here, other = line[at], line[at - 1] != line[at]
                held.append(here * width + np.where(line[at + 1] == here, 2 * size, symbol[at + 1]))
                held.append((here * width + size + symbol[at - 1])[other])
                if len(local) > HELD or sum(map(len, held)) > EVENTS:
                    yield out()
        if held:
            yield out()
        released()

    return coded.mapInArrow(run, "word string, counts binary")


def gains(table: np.ndarray, classes: int, own: np.ndarray, word: np.ndarray, context: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the log likelihood of the class bigrams ``table`` gains if a word leaves its class ``own`` for each of ``classes``,
    up to a constant of the word. ``word`` (numbers), ``context`` (as in ``contexts``) and ``n`` are the counts of several words."""
    size, m = len(table), len(own)
    dense = np.zeros((m, 2 * size + 1))
    dense[word, context] = n
    after, before, twice = dense[:, :size], dense[:, size : 2 * size], dense[:, 2 * size :]
    follow, precede = after.sum(1, keepdims=True) + twice, before.sum(1, keepdims=True) + twice
    out = np.zeros((m, classes))
    for counts, other, there in ((after, before, table[:classes]), (before, after, table[:, :classes].T)):
        w, j = np.nonzero(counts)
        if not len(w):
            continue
        found = (_f(there + 1) - _f(there)).T[j]  # of those that occur once
        left = j == own[w]
        again = np.flatnonzero(left | (counts[w, j] != 1))
        base, left = there.T[j[again]], left[again]
        base[left] -= other[w[again][left], :classes]  # the word itself is no longer there
        found[again] = _f(base + counts[w, j][again, None]) - _f(base)
        start = np.flatnonzero(np.diff(w, prepend=-1))
        out[w[start]] += np.add.reduceat(found, start)
    middle, rows, columns = table.diagonal()[:classes], table.sum(1)[:classes], table.sum(0)[:classes]
    after, before = after[:, :classes], before[:, :classes]
    out -= _f(middle + after) + _f(middle + before) - _f(middle)
    out += _f(middle + after + before + twice)
    return out - _f(rows + follow) + _f(rows) - _f(columns + precede) + _f(columns)


def placed(found: DataFrame, known: list[bytes], table: np.ndarray, classes: int, least: int) -> DataFrame:
    """(word, n, class, code) from ``contexts``: words that occur ``least`` times are put into the class that gains most,
    others into that of their shape; code is the place among ``known``, or -1."""
    size = len(table)
    names = found.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(known)})

    def judged(rows: pa.Table) -> pa.RecordBatch:
        texts, counts = (pa.concat_arrays(rows[c].chunks) for c in ("word", "counts"))
        new = np.append(True, pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False))
        number = np.cumsum(new) - 1
        own = texts.filter(pa.array(new))
        data = np.frombuffer(b"".join(counts.to_numpy(zero_copy_only=False)), np.uint64)
        key = np.repeat(number, pc.binary_length(counts).to_numpy() // 8) * (2 * size + 1) + (data & np.uint64(0xFFFF)).astype(np.int64)
        key, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, (data >> np.uint64(16)).astype(np.float64))
        word, context = np.divmod(key, 2 * size + 1)
        totals = np.bincount(word, np.where((context < size) | (context == 2 * size), n, 0), len(own))  # each word has one that follows
        of = classes + shapes(own)
        often = np.flatnonzero(totals >= least)
        start = np.searchsorted(word, np.arange(len(own) + 1))
        for k in range(0, len(often), WORDS):
            some = often[k : k + WORDS]
            sizes = start[some + 1] - start[some]
            ends = _ends(sizes)
            mine = np.arange(ends[-1]) + np.repeat(start[some] - ends[:-1], sizes)
            of[some] = gains(table, classes, of[some], np.repeat(np.arange(len(some)), sizes), context[mine], n[mine]).argmax(1)
        code = np.fromiter(map(names.value.get, own.cast(pa.binary()).to_numpy(zero_copy_only=False), itertools.repeat(-1)), np.int32, len(own))
        return pa.RecordBatch.from_arrays([own, pa.array(totals.astype(np.int64)), pa.array(of.astype(np.int32)), pa.array(code)], names=["word", "n", "class", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                rows = pa.Table.from_batches(held)
                last = rows["word"][-1].as_py()
                texts, end = rows["word"], rows.num_rows
                while end and texts[end - 1].as_py() == last:  # may go on in the next batch
                    end -= 1
                if end:
                    yield judged(rows.slice(0, end))
                    held = rows.slice(end).to_batches()
        if sum(b.num_rows for b in held):
            yield judged(pa.Table.from_batches(held))
        released()

    return found.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word string, n bigint, class int, code int")


def _met(entries: DataFrame, vocabulary: DataFrame, classes: int) -> DataFrame:
    """(_row, left, class, next, n) of words that are not sent to the executors: their class and count, the class before
    (-1 if that is such a word too) and the class after. Unseen words have n = 0 and the class of their shape."""
    found = entries.join(vocabulary.select("word", "n", "class"), "word", "left")
    found = found.select("_row", "place", "left", "right", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", _shape_of(F.col("word")) + classes).alias("class"))
    later = F.lead("class").over(Window.partitionBy("_row").orderBy("place"))
    return found.select("_row", "left", "class", F.when(F.col("right") >= 0, F.col("right")).otherwise(later).alias("next"), "n")


def count_rare_pairs(coded: DataFrame, vocabulary: DataFrame, symbols: np.ndarray, size: int) -> np.ndarray:
    """Bigrams of classes that ``count_pairs`` leaves out, as one of the words has its class in ``vocabulary``."""
    first, edge, brown = len(symbols) - 1 - SHAPES, len(symbols) - 1, size - SHAPES - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "codes"):
                line = _line(part, edge)
                at = np.flatnonzero((line >= first) & (line < edge))
                row = np.repeat(part.column(part.schema.get_field_index("_row")).to_numpy(), pc.list_value_length(part.column(part.schema.get_field_index("rare"))).to_numpy())
                arrays = [pa.array(row), part.column(part.schema.get_field_index("rare")).flatten(), pa.array(at, pa.int64()), pa.array(symbols[line[at - 1]], pa.int32()), pa.array(symbols[line[at + 1]], pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["_row", "word", "place", "left", "right"])

    entries = coded.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(run, "_row bigint, word string, place bigint, left int, right int")
    met = _met(entries, vocabulary, brown)
    pairs = F.array(F.when(F.col("left") >= 0, F.col("left") * size + F.col("class")), F.col("class") * size + F.col("next"))
    return _matrix(met.select(F.explode(pairs).alias("pair")).where("pair IS NOT NULL").groupBy(F.col("pair").cast("long").alias("pair")).agg(F.count("*").alias("n")), size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, clustered: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each symbol. The first ``clustered`` symbols move among ``classes``; each other one is a class by itself."""
    size = len(bigrams)
    of = np.concatenate((np.arange(clustered) % classes, classes + np.arange(size - clustered)))
    k = classes + size - clustered
    member = np.zeros((size, k))
    member[np.arange(size), of] = 1
    table = member.T @ bigrams @ member
    for _ in range(rounds):
        moved = 0
        for w in range(clustered):
            a, own = of[w], bigrams[w, w]
            member[w, a] = 0
            after, before = bigrams[w] @ member, bigrams[:, w] @ member  # without w itself
            table[a] -= after
            table[:, a] -= before
            table[a, a] -= own
            rows, columns = table.sum(1), table.sum(0)
            there = table[:classes]
            gain = (_f(there + after) - _f(there)).sum(1) + (_f(table[:, :classes].T + before) - _f(table[:, :classes].T)).sum(1)
            place = np.arange(classes)
            middle = table[place, place]
            gain -= _f(middle + after[:classes]) + _f(middle + before[:classes]) - 2 * _f(middle)
            gain += _f(middle + after[:classes] + before[:classes] + own) - _f(middle)
            gain -= _f(rows[:classes] + after.sum() + own) - _f(rows[:classes]) + _f(columns[:classes] + before.sum() + own) - _f(columns[:classes])
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            of[w] = b
            member[w, b] = 1
            table[b] += after
            table[:, b] += before
            table[b, b] += own
        if not moved:
            break
    return of


@dataclass
class Model:
    """``known`` words with count, class and emission; sizes of classes; transitions; the corpus's totals; all other words."""

    known: list[bytes]
    counts: np.ndarray
    classes: np.ndarray  # of the known words, then -1 for the shapes of others, then of the edge
    emissions: np.ndarray  # log10, of the known words
    sizes: np.ndarray  # of each class: tokens; of shapes' classes: tokens + types + 1
    transitions: np.ndarray  # log10
    documents: int
    tokens: int
    types: int
    vocabulary: DataFrame  # word, n, class of those that are not known


def fit(docs: DataFrame, text: str, clustered: int | None = None, classes: int = CLASSES, known: int = KNOWN, seeds: int = SEEDS, least: int = LEAST) -> Model:
    """A model of all documents. Equally frequent words rank by themselves; a null text is empty.

    The ``seeds`` most frequent words are clustered by exchange; each other word that occurs ``least`` times then joins
    the class in which it makes the bigrams likeliest, and the transitions are counted anew with all of them. If
    ``clustered`` is given, only so many words are put into classes.
    """
    vocabulary = stored(count_words(docs, text), "vocabulary")
    documents = docs.count()
    all_tokens, all_types = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = vocabulary.where(F.octet_length("word") <= WORD_BYTES).orderBy(F.col("n").desc(), "word").limit(known).toArrow()
    names = [w.encode() for w in top["word"].to_pylist()]
    counts, formed = top["n"].to_numpy().astype(np.int64), shapes(pa.concat_arrays([*top["word"].chunks, pa.array([], pa.string())]))
    head = min(seeds if clustered is None else clustered, len(names))
    coded = stored(encoded(docs, text, names), "coded")
    symbols = np.concatenate((np.arange(head), head + formed[head:], head + np.arange(SHAPES + 1))).astype(np.int32)
    bigrams = count_pairs(coded, symbols, head + SHAPES + 1)
    brown = min(classes, max(1, head))
    of = exchange(bigrams, head, brown)
    k = brown + SHAPES + 1
    own = of[symbols].astype(np.int32)
    if clustered is None:
        member = np.eye(k)[of]
        found = stored(placed(contexts(coded, names, head, own, k), names, member.T @ bigrams @ member, brown, least), "classed")
        rows = found.where("code >= 0").select("code", "class").toArrow()
        own[rows["code"].to_numpy()] = rows["class"].to_numpy()
        others = found.where("code < 0").select("word", "n", "class")
    else:
        others = vocabulary.join(docs.sparkSession.createDataFrame(top.select(["word"])), "word", "left_anti").select("word", "n", (_shape_of(F.col("word")) + brown).alias("class"))
    sizes = np.bincount(own[: len(names)], counts + (own[: len(names)] >= brown), k) + (np.arange(k) >= brown)
    for r in others.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        sizes[r["class"]] += r["n"] + (r["types"] if r["class"] >= brown else 0)
    own[len(names) : -1] = -1
    table = count_pairs(coded, own, k) + count_rare_pairs(coded, others, own, k)
    overall = (table.sum(0) + 1) / (table.sum() + k)
    transitions = np.log10((table + PRIOR * overall) / (table.sum(1, keepdims=True) + PRIOR))
    emissions = np.log10((counts + (own[: len(names)] >= brown)) / sizes[own[: len(names)]])
    return Model(names, counts, own, emissions, sizes, transitions, documents, int(all_tokens) + documents, int(all_types) + (documents > 0), others)


def score(docs: DataFrame, text: str, model: Model) -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and score of each whole text (log10 probabilities).

    Tokens are the words and an end. ``base_score`` is that of the add-one unigram model. ``text`` itself is dropped;
    other columns stay, those named as the new ones are replaced. Repeated rows are scored each; a null text is empty.
    """
    new = ("n_tokens", "n_known", "base_score", "score")
    keep = [c for c in docs.columns if c != text and c.lower() not in (*new, "_row", "_rare")]
    known, count = model.known, len(model.known)
    broadcast = docs.sparkSession.sparkContext.broadcast((known, model.counts, model.classes, model.emissions, model.transitions))
    end, ended, total = np.log10(model.documents + 1.0), model.documents > 0, np.log10(model.tokens + model.types + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, classes, emissions, transitions = broadcast.value
        places, edge = dict(zip(names, itertools.count())), np.array([count + SHAPES], np.int32)
        base = np.concatenate((np.log10(counts + 1.0), np.zeros(SHAPES + 1)))
        emitted = np.concatenate((emissions, np.zeros(SHAPES + 1)))
        for batch in batches:
            for part in slices(batch, text):
                column = dict(zip(part.schema.names, part.columns))
                flat, sizes = split(column.pop(text))
                line = np.concatenate((edge, np.insert(codes(flat, places), np.cumsum(sizes), edge)))  # an edge before, between and after texts
                after, path = line[1:], classes[line]
                start = _ends(sizes + 1)[:-1]  # of each text, in ``after``, where its own edge is the last
                left, right = path[:-1], path[1:]
                moved = np.where((left >= 0) & (right >= 0), transitions[left, right], 0)
                at = np.flatnonzero((after >= count) & (after < edge))
                own = _ends((after >= count) & (after < edge))[np.append(start, len(after))]
                place = at - np.repeat(start, np.diff(own))
                kinds = (flat.filter(pa.array((after >= count)[after < edge])), pa.array(place, pa.int32()), pa.array(left[at], pa.int32()), pa.array(path[at + 2], pa.int32()))
                rare = pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.StructArray.from_arrays(kinds, names=["word", "place", "left", "right"]))
                seen, bases, scores = (np.add.reduceat(x, start) for x in ((after < count).astype(np.int64), base[after], moved + emitted[after]))
                arrays = [pa.array(sizes + 1, pa.int64()), pa.array(seen + ended, pa.int64()), pa.array(bases + end - total * (sizes + 1)), pa.array(scores), rare]
                yield pa.RecordBatch.from_arrays([*column.values(), *arrays], names=[*column, *new, "_rare"])
        released()

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["n_tokens bigint, n_known bigint, base_score double, score double, _rare array<struct<word:string,place:int,left:int,right:int>>"])
    partial = docs.select(*[F.col(f"`{c}`") for c in keep], text).mapInArrow(run, schema)
    partial = stored(partial.withColumn("_row", F.monotonically_increasing_id()), "scored")
    brown = len(model.sizes) - SHAPES - 1
    moves = docs.sparkSession.sparkContext.broadcast((model.sizes, model.transitions))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, transitions = moves.value
        for batch in batches:
            row, left, of, later, n = (batch.column(i).to_numpy() for i in range(5))
            emitted = np.log10((n + (of >= brown)) / sizes[of]) + transitions[of, later] + np.where(left >= 0, transitions[left, of], 0)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array((n > 0).astype(np.int64)), pa.array(np.log10(n + 1.0)), pa.array(emitted)], names=["_row", "known", "base", "emitted"])

    rare = partial.select("_row", F.explode("_rare").alias("r")).select("_row", "r.*")
    met = _met(rare, model.vocabulary, brown).mapInArrow(weighed, "_row bigint, known bigint, base double, emitted double")
    found = met.groupBy("_row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("emitted").alias("emitted"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return partial.join(found, "_row", "left").select(
        *[F.col(f"`{c}`") for c in keep], "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"),
        (F.col("base_score") + zero("base")).alias("base_score"), (F.col("score") + zero("emitted")).alias("score"),
    )


def _shape_of(word):
    """``shape`` as a column."""
    size = F.octet_length(word)
    last = F.ascii(F.substring(word, -1, 1))
    ended = F.when((last < 128) & ~last.between(97, 122), 6).otherwise(0)
    wide = F.when(size > F.char_length(word), 3).otherwise(0)
    return F.when(word.rlike("[0-9]"), 0).when(~word.rlike(r"[a-zA-Z\x{80}-\x{10FFFF}]"), 1).otherwise(2 + ended + wide + (size > 4).cast("int") + (size > 9).cast("int"))
