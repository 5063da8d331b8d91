"""Suffix-array dedup: removal of long substrings that an earlier document has.

Strings of ``length`` bytes are compared where they can be equal only. Each has an anchor, the GRAM-byte string of the
smallest hash in it, so equal strings have equal anchors, and a string lies within its anchor's context, the bytes up
to ``length - GRAM`` before and behind it. Per block of documents (a range of ids) the distinct contexts are listed by
their anchors and met with those of all other blocks:

* a context that an earlier document has is removed whole: all strings in it start there too;
* each string in a context also holds half of what is left beside the anchor, on one side or the other. Where another
  context has the anchor and that half too, the side goes to a suffix array by anchor. Its Burrows-Wheeler transform is
  extended backward, breadth first, from the empty string: each step finds the suffixes whose common prefix with their
  neighbour is one byte longer, and stops at ``length``. Suffixes that are not separated by then share a string of that
  length; those of later documents are removed.
* an anchor and half that more than ``hot`` contexts have would be a group without bound: their strings meet by hash
  instead, of which each block sends one for its smallest document only.

Texts are shuffled once; what else moves is 16 bytes for each distinct context of a block, and the bytes that the
second point needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import parts_of, ranged, small_batches, tidied

LENGTH = 50
#: Bytes of an anchor. Longer ones are shared by chance less often, shorter ones are fewer.
GRAM = 16
#: Text bytes of a block, about.
BLOCK_BYTES = 8 << 20
#: Bytes that are hashed at a time.
STRIDE = 1 << 16
#: Distinct contexts of an anchor that one suffix array takes.
HOT = 1 << 15

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.Philox(key=[5, 50])).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """The minimum or maximum of each run of ``width`` elements."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = least(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(text: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, stride: int = STRIDE) -> tuple[np.ndarray, ...]:
    """Of documents that stand one behind the other: places of anchors, their hash, start, end and hash of their contexts,
    and hashes of the anchor with half the margin before it and behind it (0 where the document is too short)."""
    margin = length - gram
    half, n = margin // 2, len(text)
    power, inverse = _powers(min(n, stride + 3 * length) + 1)
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, n, stride):
        b = min(n, a + stride)
        lo, hi = max(0, a - margin), min(n, b + length + margin)
        if hi - lo < length:
            continue
        first, last = np.searchsorted(ends, [lo, hi - 1], side="right")
        own = ends[first : last + 1]
        end = np.repeat(own, np.diff(np.concatenate(([lo], np.minimum(own, hi)))))
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_TABLE[text[lo:hi]] * power[: hi - lo], out=sums[1:])
        hashed = _mixed((sums[gram:] - sums[:-gram]) * inverse[: hi - lo - gram + 1]) | _U(1)
        least = _slide(hashed, margin + 1, np.minimum)
        starts = np.arange(lo, lo + len(least))
        least[starts + length > end[: len(least)]] = 0  # it would run into the next document
        padded = np.concatenate((np.zeros(margin if lo == 0 else 0, np.uint64), least, np.zeros(margin + 1, np.uint64)))
        most = _slide(padded, margin + 1, np.maximum)  # of the windows that hold the place
        at = lo if lo == 0 else lo + margin
        places = np.arange(max(a, at), min(b, at + len(most), lo + len(hashed)))
        places = places[hashed[places - lo] == most[places - at]]
        begin = np.repeat(np.concatenate(([0], ends))[first : last + 1], np.diff(np.concatenate(([lo], np.minimum(own, hi)))))[places - lo]
        left = np.maximum(places - margin, begin)
        right = np.minimum(places + gram + margin, end[places - lo])
        context = (sums[right - lo] - sums[left - lo]) * inverse[left - lo]
        context ^= ((places - left) * 128 + (right - places)).astype(np.uint64) * _U(0xA24BAED4963EE407)
        sides = []
        for a_, b_, fits in ((places - half, places + gram, left <= places - half), (places, places + gram + margin - half + 1, right >= places + gram + margin - half + 1)):
            a_, b_ = np.where(fits, a_, lo) - lo, np.where(fits, b_, lo) - lo
            sides.append(np.where(fits, (_mixed((sums[b_] - sums[a_]) * inverse[a_]) >> _U(32)) | _U(1), 0).astype(np.uint32))
        out.append((places, hashed[places - lo], left, right, _mixed(context), *sides))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64), none.astype(np.uint32), none.astype(np.uint32)
    return tuple(np.concatenate(x) for x in zip(*out))


class Block:
    """The documents of a block in order of id, their anchors, and the distinct contexts among them."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, length: int, parts: int):
        raw = [(i, (t or "").encode()) for i, t in zip(ids.to_pylist(), texts.to_pylist())]
        raw.sort()
        self.ids = np.array([i for i, _ in raw], np.int64)
        self.text = np.frombuffer(b"".join(t for _, t in raw), np.uint8)
        self.ends = np.cumsum([len(t) for _, t in raw]).astype(np.int64)
        self.length, self.parts = length, parts

    def list(self) -> None:
        self.places, self.anchor, self.left, self.right, context, before, behind = anchors(self.text, self.ends, self.length)
        self.anchor >>= _U(1)  # the last bit is always set, and parts are dealt by remainders
        self.doc = self.ids[np.searchsorted(self.ends, self.places, side="right")] if len(self.places) else self.places
        self.context, self.first, self.which = np.unique(context, return_index=True, return_inverse=True)
        self.sides = np.stack((before[self.first], behind[self.first]), axis=1)
        self.part = (self.anchor[self.first] % _U(self.parts)).astype(np.int64)
        self.order = np.argsort(self.part, kind="stable")
        self.bounds = np.searchsorted(self.part[self.order], np.arange(self.parts + 1))

    def contexts(self):
        """For each part with any: its number, the hashes of contexts and of their sides, packed."""
        for p in np.flatnonzero(np.diff(self.bounds)):
            own = self.order[self.bounds[p] : self.bounds[p + 1]]
            yield int(p), self.context[own].tobytes() + self.sides[own].tobytes()

    def span(self, flag: np.ndarray, before: int, behind: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each anchor's context what holds the strings of the sides that are flagged."""
        margin = self.length - GRAM
        half = margin // 2
        begin = np.where(flag & before > 0, self.left, np.maximum(self.left, self.places - half + 1))
        end = np.where(flag & behind > 0, self.right, np.minimum(self.right, self.places + GRAM + margin - half))
        return begin, end

    def strings(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, place and hash of all strings of ``length`` in the given spans, each once."""
        count = np.maximum(end - begin - self.length + 1, 0)
        place = np.unique(np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum()))
        power, hashed = _powers(self.length)[0], np.empty(len(place), np.uint64)
        for k in range(0, len(place), 1 << 14):
            hashed[k : k + (1 << 14)] = (_TABLE[self.text[place[k : k + (1 << 14), None] + np.arange(self.length)]] * power).sum(axis=1, dtype=np.uint64)
        return self.ids[np.searchsorted(self.ends, place, side="right")] if len(place) else place, place, _mixed(hashed)


#: An earlier block has the context; another context has its anchor and the half before it, or behind it; many have.
SEEN, BEFORE, BEHIND, MANY_BEFORE, MANY_BEHIND = 1, 2, 4, 8, 16


def judged(blocks: list[int], payloads: list[bytes], hot: int) -> list[bytes]:
    """For each block's contexts of one part: what holds of the above."""
    sizes = [len(p) // 16 for p in payloads]
    context = np.concatenate([np.frombuffer(p, "<u8", n) for p, n in zip(payloads, sizes)])
    sides = np.concatenate([np.frombuffer(p, "<u4", 2 * n, 8 * n).reshape(-1, 2) for p, n in zip(payloads, sizes)])
    order = np.lexsort((np.repeat(blocks, sizes), sides[:, 1], sides[:, 0], context))
    fresh = np.ones(len(order), bool)  # 128 bits tell contexts apart: those of the whole and of both sides
    fresh[1:] = (context[order][1:] != context[order][:-1]) | (sides[order][1:] != sides[order][:-1]).any(axis=1)
    flags = np.zeros(len(order), np.uint8)
    flags[order[~fresh]] = SEEN
    own = order[fresh]
    for side, more, many in ((0, BEFORE, MANY_BEFORE), (1, BEHIND, MANY_BEHIND)):
        _, which, count = np.unique(sides[own, side], return_inverse=True, return_counts=True)
        count = np.where(sides[own, side] == 0, 0, count[which])
        flags[own] |= np.where(count > hot, many, np.where(count > 1, more, 0)).astype(np.uint8)
    return [x.tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1])]


def suffix_array(symbols: np.ndarray, rest: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in order of ``length`` symbols at least, up to their string's end (``rest`` symbols on, where a 0
    stands); equal ones by place.

    That is enough for intervals of strings of up to ``length``: suffixes which an order of whole suffixes would put
    otherwise lie in the same ones.
    """
    n, bits, places = len(symbols), max(1, int(symbols.max()).bit_length()), len(symbols).bit_length()
    done = (64 - places) // bits  # a key and its place in one word sort faster than a key with its places beside it
    key, longest = np.zeros(n, np.uint64), min(length, int(rest.max()) + 1)
    wide = symbols.astype(np.uint64)
    for i in range(done):
        key[: n - i] |= wide[i:] << _U(bits * (done - 1 - i))
    ended = np.array([(1 << bits * done) - (1 << bits * (done - k)) for k in range(done + 1)], np.uint64)
    key &= ended[np.minimum(rest, done)]  # nothing behind the string's end
    place, width = np.arange(n, dtype=np.uint64), bits * done
    while True:
        if width + places <= 64:
            key = np.sort(key << _U(places) | place)
            order = (key & _U((1 << places) - 1)).astype(np.int64)
            key >>= _U(places)
        else:
            order = np.argsort(key)
            key = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = ranks = np.cumsum(np.concatenate(([1], key[1:] != key[:-1])), dtype=np.uint64)
        if done >= longest or ranks[-1] == n:
            return (np.sort(rank << _U(places) | place) & _U((1 << places) - 1)).astype(np.int64)
        step, size = min(done, longest - done), int(ranks[-1]).bit_length()
        key = rank << _U(size)
        key[: n - step] |= np.where(rest[: n - step] >= step, rank[step:], _U(0))
        done, width = done + step, 2 * size


def separated(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where the common prefix of a suffix and the one before it in ``order`` is shorter than ``length``.

    Intervals of the order hold the suffixes that start with one string. All intervals of strings of one size are
    extended backward at once by every symbol that occurs in them; where an extended interval ends, the prefix shared
    with the next suffix is as long as the string it came from. Only intervals that end at such a new place go on.
    """
    n = len(symbols)
    before = symbols[order - 1].astype(np.uint16)  # the transform; 0 where a string begins
    by_symbol = np.argsort(before, kind="stable")
    to = np.empty(n, np.int32)
    to[by_symbol] = np.arange(n, dtype=np.int32)
    ordered = before[by_symbol]
    same = ordered[1:] == ordered[:-1]
    following, preceding = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    preceding[by_symbol[1:][same]] = by_symbol[:-1][same]
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    begun = before == 0  # nothing to extend by: neither last nor first of its symbol anywhere
    following[begun], preceding[begun] = -1, n
    strings = int((symbols == 0).sum())
    low, high = np.array([0]), np.array([n])
    for size in range(length):
        width = high - low
        single = low[width == 1]
        lone = to[single[before[single] != 0]]
        low, high, width = low[width > 1], high[width > 1], width[width > 1]
        total = np.cumsum(width)
        rows = np.arange(total[-1] if len(total) else 0) + np.repeat(low - total + width, width)
        new_high = np.sort(to[rows[following[rows] >= np.repeat(high, width)]]) + 1
        new_low = np.sort(to[rows[preceding[rows] < np.repeat(low, width)]])
        new_high, new_low = np.concatenate((new_high, lone + 1)), np.concatenate((new_low, lone))
        if size == 0:  # each string's end is a symbol of its own
            new_low, new_high = np.concatenate((np.arange(strings), new_low)), np.concatenate((np.arange(1, strings + 1), new_high))
        fresh = ~found[new_high]
        found[new_high] = True
        low, high = new_low[fresh], new_high[fresh]
        if not len(low):
            break
    return found[:n]


def repeated(contexts: list[bytes], docs: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(context, start, end) of bytes that lie in a string of ``length`` which a context of a smaller document has."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes + 1)
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    alphabet = np.zeros(256, np.uint16)
    stops = ends - 1
    present = np.bincount(np.delete(raw, stops), minlength=256) > 0
    alphabet[present] = np.arange(1, present.sum() + 1)
    symbols = alphabet[raw]
    symbols[stops] = 0
    rest = np.repeat(stops, sizes + 1) - np.arange(len(raw))
    order = suffix_array(symbols, rest, length)
    starts = np.flatnonzero(separated(symbols, order, length))
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    doc = docs[owner][order]
    least = np.minimum.reduceat(doc, starts)
    later = order[doc > np.repeat(least, np.diff(np.concatenate((starts, [len(order)]))))]
    if not len(later):
        return []
    later.sort()
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(later) > length) | (np.diff(owner[later]) != 0))))
    begin, end = later[cut], later[np.concatenate((cut[1:], [len(later)])) - 1] + length
    which = owner[begin]
    base = ends[which] - sizes[which] - 1
    return list(zip(which.tolist(), (begin - base).tolist(), (end - base).tolist()))


SPANS = "array<struct<start:bigint,end:bigint>>"


def without_repeats(docs: DataFrame, doc_id: str, text: str, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) for each row: its maximal removed byte spans and the bytes that remain.

    A byte goes if a string of ``length`` bytes (more than GRAM) covers it that also starts in a document of a smaller
    id; strings are judged on the input and never cross documents. A null text is empty. Rows with a null id neither
    remove nor lose anything; rows of one id don't remove from each other; an empty table gives an empty result; other
    columns are left out. A very long text is one range of ids by itself, in one task's memory several times over.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = rows.where("doc_id IS NOT NULL")
    blocked, blocks = ranged(known, "doc_id", "text", block_bytes, "block")
    parts = parts_of(blocks, block_bytes)
    by_block = blocked.select("block", "doc_id", "text").groupBy("block")

    def listed(table: pa.Table) -> pa.Table:
        block = Block(table["doc_id"], table["text"], length, parts)
        block.list()
        found = list(block.contexts())
        return pa.table({"part": pa.array([p for p, _ in found], pa.int32()), "block": pa.array([table["block"][0].as_py()] * len(found), pa.int32()), "payload": pa.array([x for _, x in found], pa.binary())})

    def met(table: pa.Table) -> pa.Table:
        numbers = table["block"].to_pylist()
        return pa.table({"block": pa.array(numbers, pa.int32()), "part": table["part"], "flags": pa.array(judged(numbers, table["payload"].to_pylist(), hot), pa.binary())})

    def chosen(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left["doc_id"], left["text"], length, parts)
        block.list()
        number = left["block"][0].as_py() if left.num_rows else 0
        flags = np.zeros(len(block.context), np.uint8)
        for part, payload in zip(right["part"].to_pylist(), right["flags"].to_pylist()):
            flags[block.order[block.bounds[part] : block.bounds[part + 1]]] = np.frombuffer(payload, np.uint8)
        flag = flags[block.which]
        gone = (flag & SEEN > 0) | (block.doc > block.doc[block.first][block.which])
        out, begin, end = [], [block.left[gone]], [block.right[gone]]
        first, last = block.span(flag, BEFORE, BEHIND)
        for own in _dealt(np.flatnonzero(~gone & (flag & (BEFORE | BEHIND) > 0)), block.anchor, blocks):
            out.append((int(block.anchor[own[0]] % _U(blocks)), number, _contexts(block, own, first, last)))
        many = np.flatnonzero(~gone & (flag & (MANY_BEFORE | MANY_BEHIND) > 0))
        first, last = block.span(flag, MANY_BEFORE, MANY_BEHIND)
        doc, place, hashed = block.strings(first[many], last[many])
        if len(doc):
            order = np.lexsort((place, doc, hashed))
            doc, place, hashed = doc[order], place[order], hashed[order]
            lead = np.maximum.accumulate(np.where(np.concatenate(([True], hashed[1:] != hashed[:-1])), np.arange(len(doc)), 0))
            later = doc > doc[lead]
            begin.append(place[later])
            end.append(place[later] + length)
            for own in _dealt(np.flatnonzero(~later), hashed, blocks):
                out.append((blocks + int(hashed[own[0]] % _U(blocks)), number, np.stack((hashed[own].view(np.int64), doc[own], place[own])).astype("<i8").tobytes()))
        local = _packed(_union(np.concatenate(begin), np.concatenate(end)))
        if local:
            out.append((-1 - number, number, local))
        return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "block": pa.array([x[1] for x in out], pa.int32()), "payload": pa.array([x[2] for x in out], pa.binary())})

    def arrays(table: pa.Table) -> pa.Table:
        spans: dict[int, list] = {}
        numbers, payloads = table["block"].to_pylist(), table["payload"].to_pylist()
        if table["part"][0].as_py() < 0:  # what a block has found itself
            return pa.table({"block": pa.array(numbers, pa.int32()), "spans": pa.array(payloads, pa.binary())})
        if table["part"][0].as_py() >= blocks:
            found = [np.frombuffer(x, "<i8").reshape(3, -1) for x in payloads]
            owner = np.repeat(numbers, [x.shape[1] for x in found])
            hashed, doc, place = np.concatenate(found, axis=1)
            order = np.lexsort((doc, hashed))
            lead = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(hashed[order]) != 0)), np.arange(len(order)), 0))
            for k in order[doc[order] > doc[order][lead]].tolist():
                spans.setdefault(int(owner[k]), []).append((int(place[k]), int(place[k]) + length))
            return pa.table({"block": pa.array(list(spans), pa.int32()), "spans": pa.array([np.array(sorted(x), "<i8").tobytes() for x in spans.values()], pa.binary())})
        contexts, docs_, lefts, owners = [], [], [], []
        for number, payload in zip(numbers, payloads):
            doc, left, texts = _read(payload)
            contexts += texts
            docs_.append(doc)
            lefts += left.tolist()
            owners += [number] * len(texts)
        for which, start, end in repeated(contexts, np.concatenate(docs_), length):
            spans.setdefault(owners[which], []).append((lefts[which] + start, lefts[which] + end))
        return pa.table({"block": pa.array(list(spans), pa.int32()), "spans": pa.array([np.array(sorted(x), "<i8").tobytes() for x in spans.values()], pa.binary())})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left["doc_id"], left["text"], length, parts)
        pairs = np.concatenate([np.zeros((0, 2), "<i8")] + [np.frombuffer(p, "<i8").reshape(-1, 2) for p in right["spans"].to_pylist()])
        begin, end = _union(pairs[:, 0], pairs[:, 1])
        removed, kept, at = [], [], 0
        data = block.text.tobytes()
        for stop in block.ends.tolist():
            lo, hi = np.searchsorted(end, at, side="right"), np.searchsorted(begin, stop)  # a run may go on in the next document
            own = list(zip(np.maximum(begin[lo:hi], at).tolist(), np.minimum(end[lo:hi], stop).tolist()))
            removed.append([{"start": a - at, "end": b - at} for a, b in own])
            kept.append(b"".join(data[a:b] for a, b in zip([at] + [b for _, b in own], [a for a, _ in own] + [stop])))
            at = stop
        sizes = np.diff(np.concatenate(([0], block.ends)))
        return pa.table({"doc_id": pa.array(block.ids), "n_bytes": pa.array(sizes, pa.int64()), "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    small_batches(docs.sparkSession)
    listed, met, chosen, arrays, cut = map(tidied, (listed, met, chosen, arrays, cut))
    flags = by_block.applyInArrow(listed, "part int, block int, payload binary").groupBy("part").applyInArrow(met, "block int, part int, flags binary")
    sent = by_block.cogroup(flags.groupBy("block")).applyInArrow(chosen, "part int, block int, payload binary")
    spans = sent.groupBy("part").applyInArrow(arrays, "block int, spans binary")
    out = by_block.cogroup(spans.groupBy("block")).applyInArrow(cut, f"doc_id bigint, n_bytes bigint, removed {SPANS}, kept binary")
    idless = rows.where("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast(SPANS).alias("removed"), F.col("text").cast("binary").alias("kept"))
    return out.unionByName(idless)


def _union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the given spans; spans that touch become one."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > reach[:-1]))
    return begin[new], reach[np.concatenate((new[1:], [True]))]


def _dealt(own: np.ndarray, keys: np.ndarray, parts: int) -> list[np.ndarray]:
    """``own`` by the part that their keys belong to."""
    if not len(own):
        return []
    part = keys[own] % _U(parts)
    order = np.argsort(part, kind="stable")
    return np.split(own[order], np.flatnonzero(np.diff(part[order])) + 1)


def _packed(spans: tuple[np.ndarray, np.ndarray]) -> bytes:
    return np.stack(spans, axis=1).astype("<i8").tobytes()


def _contexts(block: Block, own: np.ndarray, first: np.ndarray, last: np.ndarray) -> bytes:
    """Number, documents, places, sizes and bytes of contexts."""
    left, size = first[own], last[own] - first[own]
    data = memoryview(block.text)
    body = b"".join([data[a : a + n] for a, n in zip(left.tolist(), size.tolist())])
    return np.int64(len(own)).tobytes() + block.doc[own].astype("<i8").tobytes() + left.astype("<i8").tobytes() + size.astype("<i2").tobytes() + body


def _read(payload: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    n = int(np.frombuffer(payload, "<i8", 1)[0])
    doc, left, size = np.frombuffer(payload, "<i8", n, 8), np.frombuffer(payload, "<i8", n, 8 + 8 * n), np.frombuffer(payload, "<i2", n, 8 + 16 * n)
    ends = (np.cumsum(size, dtype=np.int64) + 8 + 18 * n).tolist()
    return doc, left, [payload[b - s : b] for b, s in zip(ends, size.tolist())]
