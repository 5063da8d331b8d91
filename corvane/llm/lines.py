"""Line dedup by a segment-partition edit join.

How many edits two lines may be apart depends on the length of the shorter one: one for each EVERY code points of it,
DISTANCE at most. Lines within so many edits of each other agree in one of as many even segments of the shorter one and
one more, at nearly the same place. Each line lists its own segments, and probes the segments that a line of its length
or somewhat less could have, at the few starts that leave enough edits for both sides. Lines that meet in a segment are
compared by a banded bit-parallel edit distance. Equal lines, and lines that are too short for an edit, meet by their
hash alone.

Documents are taken in blocks by ranges of ids; a block sends each distinct line's hashes once, and the text of a line
only where it is the first of its kind and a segment has met another line. The texts are shuffled once.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import combinations
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import parts_of, ranged, small_batches, tidied

#: Edits that lines may be apart, and code points that the shorter one needs for each.
DISTANCE, EVERY = 2, 16
BLOCK_BYTES = 8 << 20
#: Lines that meet in a segment and are compared as they are; more of them have to meet in a further segment.
GROUP = 256
#: Distinct lines of a segment that one task takes; beyond it they meet in two segments from the start.
HOT = 1 << 15

_WHITE = " \t\n\r\x0b\x0c"
#: Where segments were taken out, nothing between them.
_MARKS = re.compile("\0+")


def segments(size: int, distance: int) -> list[tuple[int, int]]:
    """Start and size of the even segments of a line; the last ones may be one longer."""
    parts, out, at = distance + 1, [], 0
    for i in range(parts):
        n = size // parts + (i >= parts - size % parts)
        out.append((at, n))
        at += n
    return out


def allowed(size: int, distance: int = DISTANCE, every: int = EVERY) -> int:
    """How many edits a line may be apart from another one that is as long or longer."""
    return min(distance, size // every) if every else distance


def probes(line: str, distance: int = DISTANCE, every: int = 0) -> Iterator[tuple[int, bool, int, int, int]]:
    """(key, own, start, size, limit) of a line's own segments and of those it has to look for in lines not longer than
    it; limit is the number of edits that may be between."""
    n = len(line)
    for less in range(distance + 1):
        size = n - less
        limit = allowed(size, distance, every)
        if size < 0 or less > limit or not limit:
            continue
        for i, (at, width) in enumerate(segments(size, limit)):
            if not width:
                continue
            room = limit - i
            for start in range(max(0, at - i, at + less - room), min(n - width, at + i, at + less + room) + 1):
                yield xxhash.xxh64_intdigest(line[start : start + width].encode(), size * 16 + i), less == 0 and start == at, start, width, limit


def within(a: str, b: str, distance: int) -> bool:
    """Is the edit distance at most ``distance``? What both have at either end is left out; the rest is compared column
    by column, in a band of 2 * distance + 1 diagonals that are bits of one word."""
    if abs(len(a) - len(b)) > distance:
        return False
    head = _common(a, b)
    a, b = a[head:], b[head:]
    tail = _common(a[::-1], b[::-1]) if a and b else 0
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b) <= distance
    # reach[e]: bit d set if the diagonal (place in b less place in a) d - distance is reachable with e edits so far
    width, full = 2 * distance + 1, (1 << 2 * distance + 1) - 1
    reach = [0] * (distance + 1)
    reach[0] = 1 << distance
    n, m = len(a), len(b)
    for i in range(-1, n):
        for e in range(1, distance + 1):  # a letter of b more
            reach[e] |= reach[e - 1] << 1 & full
        if i == n - 1:
            break
        x = a[i + 1]
        equal = 0
        for d in range(width):
            j = i + 1 + d - distance
            if 0 <= j < m and b[j] == x:
                equal |= 1 << d
        valid = 0
        for d in range(width):
            if i + 1 + d - distance < m:
                valid |= 1 << d
        new = []
        for e in range(distance + 1):
            step = reach[e] & equal
            if e:
                step |= reach[e - 1] & valid | reach[e - 1] >> 1  # another letter, or one of a more
            new.append(step)
        reach = new
        if not any(reach):
            return False
    end = m - n + distance
    return 0 <= end < width and any(r >> end & 1 for r in reach)


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Block:
    """The documents of a block in order of id and text, and the first of each distinct line among them."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, distance: int, every: int):
        raw = sorted(zip(ids.to_pylist(), texts.to_pylist(), range(len(ids))))
        self.ids, self.lines, self.rows = [i for i, _, _ in raw], [t.split("\n") for _, t, _ in raw], [k for _, _, k in raw]
        self.distance, self.every = distance, every
        self.at: list[tuple[int, int]] = []  # document and number of each distinct line's first place
        self.line: list[str] = []
        self.repeats: list[tuple[int, int]] = []
        seen: dict[str, int] = {}
        for d, own in enumerate(self.lines):
            for k, line in enumerate(own):
                line = line.strip(_WHITE)
                if not line:
                    continue
                if line in seen:
                    self.repeats.append((d, k))
                else:
                    seen[line] = len(self.line)
                    self.line.append(line)
                    self.at.append((d, k))

    def entries(self, parts: int):
        """Hashes of lines, and per segment: key, line and whether it is the line's own; each with its order by part."""
        digests = [xxhash.xxh3_128_digest(x.encode()) for x in self.line]
        self.hash = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        keys, own, lines, start, size, limit = array("Q"), array("B"), array("i"), array("i"), array("i"), array("B")
        for k, line in enumerate(self.line):
            for key, o, s, w, e in probes(line, self.distance, self.every):
                lines.append(k)
                keys.append(key)
                own.append(o)
                start.append(s)
                size.append(w)
                limit.append(e)
        self.key, self.own, self.which = np.array(keys, np.uint64), np.array(own, np.uint8), np.array(lines, np.int32)
        self.start, self.size, self.limit = start, size, limit
        self.by_hash = _by_part(self.hash[:, 0], parts)
        self.by_key = _by_part(self.key, parts)


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def known_before(blocks: list[int], payloads: list[bytes]) -> list[bytes]:
    """For each block's line hashes: has an earlier block the line?"""
    sizes = [len(p) // 16 for p in payloads]
    hashes = np.concatenate([np.frombuffer(p, "<u8").reshape(-1, 2) for p in payloads])
    order = np.lexsort((np.repeat(blocks, sizes), hashes[:, 1], hashes[:, 0]))
    same = np.zeros(len(order), np.uint8)
    same[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]).all(axis=1)
    return [x.tobytes() for x in np.split(same, np.cumsum(sizes)[:-1])]


MET, MANY = 1, 2


def met(payloads: list[bytes], hot: int) -> list[bytes]:
    """For each block's segments: have different lines met there, one of which owns it (MET)? More than ``hot`` (MANY)?"""
    sizes = [len(p) // 17 for p in payloads]
    key = np.concatenate([np.frombuffer(p, "<u8", n) for p, n in zip(payloads, sizes)])
    line = np.concatenate([np.frombuffer(p, "<u8", n, 8 * n) for p, n in zip(payloads, sizes)])
    own = np.concatenate([np.frombuffer(p, np.uint8, n, 16 * n) for p, n in zip(payloads, sizes)])
    order = np.lexsort((line, key))
    key, line, own = key[order], line[order], own[order]
    first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    fresh = (first | np.concatenate(([True], line[1:] != line[:-1]))).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    lines, owned = (np.add.reduceat(fresh, start), np.maximum.reduceat(own, start)) if len(start) else (start, start)
    flag = np.where((lines > 1) & (owned > 0), np.where(lines > hot, MANY, MET), 0)
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(flag, np.diff(np.concatenate((start, [len(order)]))))
    return [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]


Member = tuple[tuple[int, int], str, str, bool]  # place (document id, line number), the line, what lies beside the segment, owner?


def later_alike(members: list[Member], limit: int, group: int = GROUP, found: set | None = None) -> set[tuple[int, int]]:
    """Places of lines within ``limit`` edits of a line that stands earlier, among lines that met in one segment; those in
    ``found`` are known already, and returned with the new ones.

    Large groups meet again in what they have beside the segment, which is within the same distance: its segments are
    probed in the same way, so no more pairs are compared than share those too. A line that has the segment at several
    starts is a member with each of the rests, as only one of them may be close to the other line's. What all rests of a
    group begin and end with changes no distance and is left out, so lines of a template come down to what differs. Short
    rests meet in
    what is left of them without a few letters. Where no line is left to be settled, nothing is compared.
    """
    out = set() if found is None else found
    places: dict[tuple[int, int], tuple[str, bool]] = {}
    for place, line, _, own in sorted(members, key=lambda m: m[0]):
        places[place] = (line, own or place in places and places[place][1])
    lines = [(place, *x) for place, x in places.items()]
    if all(place in out for place in list(places)[1:]):
        return out
    if len(lines) <= group:
        for k, (place, line, own) in enumerate(lines):
            if place not in out:
                for _, other, owner in lines[:k]:
                    if (own or owner) and other != line and within(line, other, limit):
                        out.add(place)
                        break
        return out
    rests = [rest for _, _, rest, _ in members]
    head = len(commonprefix(rests))
    tail = min(len(commonprefix([rest[::-1] for rest in rests])), min(map(len, rests)) - head)
    members = [(place, line, rest[head : len(rest) - tail], own) for place, line, rest, own in members]
    if max(map(len, rests)) - head - tail <= 4 * (limit + 1):
        _settle_short(sorted(members, key=lambda m: m[0]), limit, out)
        return out
    again: dict[int, dict[tuple, Member]] = defaultdict(dict)
    for place, line, rest, _ in members:
        for key, own, start, size, _ in probes(rest, limit):
            left = _MARKS.sub("\0", rest[:start] + "\0" + rest[start + size :])
            if (place, left) not in again[key] or own:
                again[key][place, left] = (place, line, left, own)
    for own_members in sorted(again.values(), key=len, reverse=True):  # large ones settle most
        if len(own_members) > 1 and any(m[3] for m in own_members.values()):
            later_alike(list(own_members.values()), limit, group, out)
    return out


def _without(rest: str, most: int) -> set[str]:
    """The text and what is left of it after up to ``most`` deletions."""
    out = last = {rest}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


def _settle_short(members: list[Member], limit: int, out: set) -> None:
    """Adds to ``out`` the places of members (in order) that have one within ``limit`` edits before them, by their rests.

    Rests of equal length that replacements tell apart meet in what all places but as many have; others meet where the
    one is left of ``limit`` deletions at most and the other of fewer. All that meet are compared, the earliest first,
    which mostly settles the matter.
    """

    def settles(at: int, before: list[int]) -> bool:
        place, line = members[at][:2]
        if any(members[k][0] < place and members[k][1] != line and within(line, members[k][1], limit) for k in before):
            out.add(place)
            return True
        return False

    by_size: dict[int, list[int]] = defaultdict(list)
    for k, member in enumerate(members):
        by_size[len(member[2])].append(k)
    for size, own in by_size.items():
        for gone in combinations(range(size), min(limit, size)):
            cuts = [(a + 1, b) for a, b in zip((-1, *gone), (*gone, size))]
            seen: dict[str, list[int]] = defaultdict(list)
            for k in own:
                rest = members[k][2]
                met_there = seen["".join([rest[a:b] for a, b in cuts])]
                if members[k][0] not in out:
                    settles(k, met_there)
                met_there.append(k)
    left: dict[str, list[int]] = defaultdict(list)
    for k, member in enumerate(members):
        for x in _without(member[2], limit - 1):
            left[x].append(k)
    open_ = [k for k, m in enumerate(members) if m[0] not in out and m[0] != members[0][0]]
    for k in open_:
        any(settles(k, left[x]) for x in _without(members[k][2], limit) if x in left)
    shorter: dict[str, list[int]] = defaultdict(list)
    for k in open_:
        if members[k][0] not in out:
            for x in _without(members[k][2], limit - 1):
                shorter[x].append(k)
    if shorter:
        for k, member in enumerate(members):
            for x in _without(member[2], limit) & shorter.keys():
                for later in shorter[x]:
                    if members[later][0] not in out:
                        settles(later, [k])


def without_repeats(docs: DataFrame, doc_id: str, text: str, distance: int = DISTANCE, every: int = EVERY, block_bytes: int = BLOCK_BYTES, hot: int = HOT, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_lines, removed, kept) for each row: the numbers (from 0) of its removed lines, and the text without them;
    then the columns ``carry``, which may not have those names.

    Lines are parted by line feeds and compared without the ASCII white space around them; blank ones stay. A line goes
    if an equal one stands before it, in order of doc_id, then text, then place; or one that is apart by no more edits
    (insert, delete, replace a code point) than one for each ``every`` code points of the shorter one, ``distance`` at
    most. What stands before counts whether it is itself removed or not. A null text is one empty line. Rows with a null
    id are left as they are; an empty table gives an empty result; other columns than ``carry`` are left out. A very long
    line is compared like any other, and a very long text is one range of ids by itself, in one task.
    """
    if {c.lower() for c in carry} & {"doc_id", "text", "block", "n_lines", "removed", "kept"}:
        raise ValueError(f"a carried column has the name of a new one: {carry}")
    carried = [F.col(f"`{c}`") for c in carry]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *carried)
    given = rows.where("doc_id IS NOT NULL")
    blocked, blocks = ranged(given, "doc_id", "text", block_bytes, "block")
    parts = parts_of(blocks, block_bytes)
    by_block = blocked.select("block", "doc_id", "text", *carried).groupBy("block")

    def loaded(table: pa.Table) -> tuple[int, Block]:
        block = Block(table["doc_id"], table["text"], distance, every)
        return (table["block"][0].as_py() if table.num_rows else -1), block

    def listed(table: pa.Table) -> pa.Table:
        number, block = loaded(table)
        block.entries(parts)
        out = []
        order, bound = block.by_hash
        for p in np.flatnonzero(np.diff(bound)).tolist():
            out.append((p, block.hash[order[bound[p] : bound[p + 1]]].tobytes()))
        order, bound = block.by_key
        for p in np.flatnonzero(np.diff(bound)).tolist():
            own = order[bound[p] : bound[p + 1]]
            out.append((parts + p, block.key[own].tobytes() + block.hash[block.which[own], 0].tobytes() + block.own[own].tobytes()))
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "block": pa.array([number] * len(out), pa.int32()), "payload": pa.array([x for _, x in out], pa.binary())})

    def judged(table: pa.Table) -> pa.Table:
        numbers, payloads = table["block"].to_pylist(), table["payload"].to_pylist()
        flags = known_before(numbers, payloads) if table["part"][0].as_py() < parts else met(payloads, hot)
        return pa.table({"block": table["block"], "part": table["part"], "flags": pa.array(flags, pa.binary())})

    def chosen(left: pa.Table, right: pa.Table) -> pa.Table:
        number, block = loaded(left)
        block.entries(parts)
        before, flag = np.zeros(len(block.line), np.uint8), np.zeros(len(block.key), np.uint8)
        for part, payload in zip(right["part"].to_pylist(), right["flags"].to_pylist()):
            into, (order, bound) = (before, block.by_hash) if part < parts else (flag, block.by_key)
            into[order[bound[part % parts] : bound[part % parts + 1]]] = np.frombuffer(payload, np.uint8)
        out: list[tuple] = [(-1 - number, number, None, d, k, None, None, None) for d, k in block.repeats]
        out += [(-1 - number, number, None, *block.at[i], None, None, None) for i in np.flatnonzero(before)]
        for e in np.flatnonzero((flag > 0) & (before[block.which] == 0)).tolist():
            line, key, start, size, limit = block.line[block.which[e]], int(block.key[e]), block.start[e], block.size[e], block.limit[e]
            d, k = block.at[block.which[e]]
            rest, asked = line[:start] + "\0" + line[start + size :], [(key, bool(block.own[e]))]
            if flag[e] == MANY:
                asked = [(xxhash.xxh64_intdigest(key.to_bytes(8, "little"), further), own) for further, own, _, _, _ in probes(rest, limit)]
            for key, own in asked:
                out.append((key % blocks, number, key - (1 << 63), d, k, limit, line, rest if own else "\1" + rest))
        names = ("part", "block", "key", "doc", "number", "edits", "line", "rest")
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())))})

    def compared(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() < 0:
            return table.select(["block", "doc", "number"])
        groups: dict[tuple[int, int], dict[tuple, tuple]] = defaultdict(dict)
        for block, key, doc, number, limit, line, rest in zip(*(table[c].to_pylist() for c in ("block", "key", "doc", "number", "edits", "line", "rest"))):
            own, place = rest[0] != "\1", (block, doc, number)
            rest = rest if own else rest[1:]
            if (place, rest) not in groups[key, limit] or own:
                groups[key, limit][place, rest] = (place, line, rest, own)
        out: set = set()
        for (_, limit), members in groups.items():
            later_alike(list(members.values()), limit, found=out)
        found = sorted(out)
        return pa.table({n: pa.array([x[i] for x in found], pa.int32()) for i, n in enumerate(("block", "doc", "number"))})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        _, block = loaded(left)
        gone: dict[int, set[int]] = defaultdict(set)
        for d, k in zip(right["doc"].to_pylist(), right["number"].to_pylist()):
            gone[d].add(k)
        kept = ["\n".join([x for k, x in enumerate(own) if k not in gone[d]] if d in gone else own) for d, own in enumerate(block.lines)]
        removed = [sorted(gone[d]) if d in gone else [] for d in range(len(kept))]
        return pa.table({"doc_id": pa.array(block.ids, pa.int64()), "n_lines": pa.array([len(x) for x in block.lines], pa.int64()), "removed": pa.array(removed, pa.list_(pa.int32())), "kept": pa.array(kept, pa.string())} | {c: left[c].take(block.rows).combine_chunks() for c in carry})

    small_batches(docs.sparkSession)
    listed, judged, chosen, compared, cut = map(tidied, (listed, judged, chosen, compared, cut))
    flags = by_block.applyInArrow(listed, "part int, block int, payload binary").groupBy("part").applyInArrow(judged, "block int, part int, flags binary")
    sent = by_block.cogroup(flags.groupBy("block")).applyInArrow(chosen, "part int, block int, key bigint, doc int, number int, edits int, line string, rest string")
    gone = sent.groupBy("part").applyInArrow(compared, "block int, doc int, number int")
    schema = ", ".join(["doc_id bigint, n_lines bigint, removed array<int>, kept string"] + [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry])
    out = by_block.cogroup(gone.groupBy("block")).applyInArrow(cut, schema)
    idless = rows.where("doc_id IS NULL").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.array().cast("array<int>").alias("removed"), F.col("text").alias("kept"), *carried)
    return out.unionByName(idless)
