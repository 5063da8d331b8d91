"""Byte-level BPE by monoid tree reduction.

A text is cut into leaves of a few pieces, each leaf is encoded as if it stood alone, and neighbours are joined pair by
pair until one node is left. A node has its pieces (the matches of the pattern) and their ids. Behind a letter that no
letter follows, or behind a digit that no digit follows, every reading of the text starts a new piece. Such a place is a
rim, and leaves end at one where there is one near: two nodes that meet at a rim are one behind the other as they are.
Where two others meet, a window of the last and the first piece is read and encoded again; it grows, a piece at a time,
until both its ends are rims. So what lies outside the window cannot depend on what lies within, and its ids are final.

Pieces that are longer than any token go the same way: their bytes are cut into leaves, and two runs of ids are joined
by encoding a growing window of ids around the seam. It ends where the ids on either side of its ends, merged by
themselves, stay apart: ids of which each two neighbours stay apart are the encoding of the bytes that they stand for,
as the first merge across a seam would be the first one across it in those two alone too.

Decoding concatenates up a tree of the same kind.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import gc
import itertools
import re
import struct
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvane.llm._common import with_row_columns

#: Code points of a leaf of a text (and up to as many more, up to the next rim), bytes of a leaf of a long piece, ids of a
#: leaf when decoding.
LEAF = 128
#: Pieces whose ids a process remembers; bytes of a piece that is merged together with others, and how many of them.
MEMORY, SHORT, ROWS = 1 << 18, 32, 1 << 12
#: The rank of two neighbours that make no token.
NONE = 1 << 30
#: The last letter of a piece and the first of the next one, if the place between them is a rim.
RIM = regex.compile(r"\p{L}\P{L}|\p{N}\P{N}")
#: What classes of a pattern hold of ASCII, and a pattern's escapes, brackets and other marks.
ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": "\t-\r ", r"\S": "^\t-\r "}
MARKS = re.compile(r"\\[pP]\{\w+\}|\\.|\(\?|.", re.DOTALL)

#: Pieces of a text, and the ids of each, packed.
Node = tuple[list[str], list[bytes]]


class ByteBPE:
    """Encodes by the ranks of a vocabulary; each match of ``pattern`` is encoded separately, without special tokens.

    The rims hold for patterns whose pieces are an optional space and a run of letters, of digits or of neither, runs
    of white space, and contractions of an apostrophe and letters.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        self.ranks, self.name, self.leaf = ranks, {v: k for k, v in ranks.items()}, max(1, leaf)
        self.longest = max(map(len, ranks))
        self.split_any = regex.compile(pattern).findall
        self.split_ascii = _for_ascii(pattern) or self.split_any
        self.is_rim = functools.cache(lambda seam: RIM.match(seam) is not None)
        self.apart = functools.lru_cache(MEMORY)(self._apart)
        self.codes = _Codes(self.piece)

    def _apart(self, a: int | None, b: int) -> bool:
        """Does merging leave the bytes of two tokens, or of ``b`` alone, as these tokens?"""
        return self.merge(self.name[b] if a is None else self.name[a] + self.name[b]) == ([b] if a is None else [a, b])

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        return self.packed_all([text])[0]

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """``packed`` of each text. The pieces of all leaves that are new are merged at a time."""
        known, code = self.codes.get, self.codes.__getitem__
        nodes = [[(pieces, list(map(known, pieces))) for pieces in map(self.split, self.leaves(text))] for text in texts]
        unmet = [(codes, i, pieces[i]) for own in nodes for pieces, codes in own if None in codes for i, c in enumerate(codes) if c is None]
        self.learn({p for _, _, p in unmet})
        for codes, i, p in unmet:
            codes[i] = code(p)
        return [b"".join(_reduced(own, self.join)[1]) if own else b"" for own in nodes]

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        return self.split_ascii(text) if text.isascii() else self.split_any(text)

    def leaves(self, text: str) -> list[str]:
        """The text in parts that end at a rim, the first one from ``leaf`` code points on, or there if none is near."""
        out, start, size, rim = [], 0, self.leaf, RIM.search
        while len(text) - start > size:
            found = rim(text, start + size - 1, start + 2 * size)
            end = found.start() + 1 if found else start + size
            out.append(text[start:end])
            start = end
        if start < len(text):
            out.append(text[start:])
        return out

    def join(self, left: Node, right: Node) -> Node:
        """The node of both texts, one behind the other."""
        (pieces, codes), (behind, after) = left, right
        if self.is_rim(pieces[-1][-1] + behind[0][0]):
            pieces += behind
            codes += after
            return pieces, codes
        keep, skip = len(pieces) - 1, 1
        while keep and not self.is_rim(pieces[keep - 1][-1] + pieces[keep][0]):
            keep -= 1
        while skip < len(behind) and not self.is_rim(behind[skip - 1][-1] + behind[skip][0]):
            skip += 1
        last, first = pieces[keep:], behind[:skip]
        window = self.split("".join(last + first))
        if len(window) == len(last) == len(first) == 1 and min(len(last[0]), len(first[0])) > self.longest:  # one long piece
            ids = [self.seam(codes[-1], after[0])]
        else:
            ids = [self.codes[p] for p in window]
        pieces[keep:], codes[keep:] = window, ids
        pieces += behind[skip:]
        codes += after[skip:]
        return pieces, codes

    def piece(self, piece: str) -> bytes:
        """The ids of a piece: its own one where it is a token, else those that merging gives."""
        data = piece.encode()
        if (whole := self.ranks.get(data)) is not None:
            return array("i", [whole]).tobytes()
        return _reduced([array("i", self.merge(data[i : i + self.leaf])).tobytes() for i in range(0, len(data), self.leaf)], self.seam)

    def seam(self, left: bytes, right: bytes) -> bytes:
        """The ids of two runs of bytes, one behind the other, from the ids of each."""
        size = 1
        while True:
            before, behind = array("i", left[-4 * size :]), array("i", right[: 4 * size])
            window = self.merge(b"".join([self.name[i] for i in before + behind]))
            keep, skip = len(left) - 4 * len(before), 4 * len(behind)
            if not keep or self.apart(array("i", left[keep - 4 : keep])[0], window[0]):
                if skip == len(right) or self.apart(window[-1], array("i", right[skip : skip + 4])[0]):
                    return left[:keep] + array("i", window).tobytes() + right[skip:]
            size *= 2

    def merge(self, data: bytes) -> list[int]:
        """Ids of bytes by merging: time and again the leftmost pair of neighbours that makes the token of least rank."""
        rank, none = self.ranks.get, NONE
        cuts = list(range(len(data) + 1))  # where parts begin, and the end
        pairs = [rank(data[i : i + 2], none) for i in cuts[:-2]]  # of each part and the next
        pairs.append(none)
        while (least := min(pairs)) < none:
            at = pairs.index(least)
            while True:
                del cuts[at + 1], pairs[at + 1]
                pairs[at] = new = rank(data[cuts[at] : cuts[at + 2]], none) if at + 2 < len(cuts) else none
                if at:
                    pairs[at - 1] = before = rank(data[cuts[at - 1] : cuts[at + 1]], none)
                    new = min(new, before)
                if len(cuts) < self.leaf or new < least or least not in pairs[at:]:
                    break
                at = pairs.index(least, at)  # many parts: go on behind as long as no lower rank has come up
        return [self.ranks[data[a:b]] for a, b in zip(cuts, cuts[1:])]

    def learn(self, pieces: Iterable[str]) -> None:
        """Remembers the ids of short pieces, which are merged all at a time, a row of a matrix each."""
        codes, ranks, one = self.codes, self.ranks, struct.Struct("i").pack
        before = codes.turned().get
        new: list[list[tuple[str, bytes]]] = [[] for _ in range(SHORT + 1)]  # by length
        for p in pieces:
            if (found := before(p)) is not None:
                codes[p] = found
                continue
            data = p.encode()
            if (whole := ranks.get(data)) is not None:
                codes[p] = one(whole)
            elif len(data) <= SHORT:
                new[len(data)].append((p, data))
        rows = list(itertools.chain.from_iterable(new))
        for k in range(0, len(rows), ROWS):
            some = rows[k : k + ROWS]
            ids, count = self._merged([d for _, d in some])
            flat, width = ids.tobytes(), 4 * ids.shape[1]
            codes.update((p, flat[at : at + 4 * n]) for (p, _), at, n in zip(some, range(0, len(flat), width), count))

    def _merged(self, rows: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """``merge`` of each row: a matrix of ids and how many there are in each row.

        Cells are numbered throughout. A part is in the cell of its first byte and has the cells of its neighbours; the
        last cell of a row has no part, and so is the neighbour of the next row's first one too."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        width = int(sizes.max()) + 1
        raw = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in rows]), np.uint8).reshape(-1, width)
        column = np.arange(width)
        ids = np.where(column < sizes[:, None], self.of_byte[raw], np.int32(-1))
        pairs = np.full(raw.shape, NONE, np.int32)
        pairs[:, :-1] = np.where(column[1:] < sizes[:, None], self.of_bytes[raw[:, :-1], raw[:, 1:]], np.int32(NONE))
        part, pair = ids.ravel(), pairs.ravel()  # the same by number of the cell
        later, earlier = np.arange(1, len(part) + 1), np.arange(-1, len(part) - 1)
        of = np.arange(len(rows))  # rows that may go on
        while len(of):
            own = pairs.take(of, 0)
            at = own.argmin(1)
            least = own[np.arange(len(of)), at]
            go = least < NONE
            if not go.all():
                of, at, least = of[go], at[go], least[go]
            at += of * width
            gone, before = later[at], earlier[at]
            behind = later[gone]
            part[at], part[gone], pair[gone] = least, -1, NONE
            later[at], earlier[behind] = behind, at
            found = self._pairs(np.concatenate((least, part[before])), np.concatenate((part[behind], least)))
            pair[at], pair[before] = found[: len(of)], found[len(of) :]
        kept = ids >= 0
        count = kept.sum(1)
        out = np.full(ids.shape, -1, np.int32)
        out[column < count[:, None]] = ids[kept]
        return out, count.tolist()

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each two make, NONE if they make none."""
        keys, made = self.table
        key = (left.astype(np.int64) << 32) + right
        found = np.searchsorted(keys, key)
        return np.where((keys[found] == key) & (left >= 0) & (right >= 0), made[found], np.int32(NONE))

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens that make one, packed and in order, and the one that they make."""
        ranks = self.ranks
        made = sorted(((ranks[t[:i]] << 32) + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        return np.array([k for k, _ in made] + [1 << 62]), np.array([r for _, r in made] + [0], np.int32)

    @functools.cached_property
    def of_byte(self) -> np.ndarray:
        return np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    @functools.cached_property
    def of_bytes(self) -> np.ndarray:
        """The rank of the token that each two bytes make."""
        return self._pairs(*np.broadcast_arrays(self.of_byte[:, None], self.of_byte))

    def decode(self, ids) -> bytes:
        name, ids = self.name.__getitem__, ids if isinstance(ids, list) else ids.tolist()
        return _reduced([b"".join(map(name, ids[k : k + self.leaf])) for k in range(0, len(ids), self.leaf)], bytes.__add__) if ids else b""


class _Codes(dict):
    """Ids of the pieces met so far; when there are too many, those that have not been met lately are forgotten."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of, self.before = ids_of, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece)
        if found is None:
            found = self.ids_of(piece)
        if len(piece) <= LEAF:
            self.turned()
            self[piece] = found
        return found

    def turned(self) -> dict[str, bytes]:
        """The pieces of before, which are those of now where these have become too many."""
        if len(self) >= MEMORY:
            self.before = dict(self)
            self.clear()
        return self.before


@contextlib.contextmanager
def _uncollected():
    """Without the search for cycles, which would go through lists of pieces again and again and find none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _for_ascii(pattern: str):
    """The matches of the pattern in ASCII texts, by the library that is faster there; None if the pattern has something
    else than literals, groups without flags and the classes of ASCII."""
    out, inside = [], False
    for mark in MARKS.findall(pattern):
        if mark[0] == "\\":
            if mark not in ASCII or inside and mark == r"\S":
                return None
            mark = ASCII[mark] if inside else f"[{ASCII[mark]}]"
        elif mark in "[]":
            if inside == (mark == "["):
                return None
            inside = not inside
        out.append(mark)
    found = "".join(out)
    return None if re.search(r"\(\?[^:=!]", found) else re.compile(found).findall


def _reduced(nodes: list, join):
    """The nodes joined two by two, and what comes of that again, until one is left."""
    while len(nodes) > 1:
        joined = [join(a, b) for a, b in zip(nodes[::2], nodes[1::2])]
        nodes = joined + nodes[len(nodes) // 2 * 2 :]
    return nodes[0]


@functools.lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBPE:
    """The tokenizer of a file of ranks (a base64 token and its rank a line), once in each process."""
    with open(path, "rb") as file:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)


def encode(df: DataFrame, text: str, path: str, pattern: str, out: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of each whole text as array<int>; a null or empty text has none, an empty table gives an empty one.
    ``decoded`` names a column for the bytes that the ids decode to, as ``decode`` would add it, without a way back and forth.

    Rows are independent: nothing is shuffled, repeated rows and ties need no rule. A very long text is one value and
    takes one task's time, about in proportion to its length. Other columns stay; one that is named as ``out`` is
    replaced. ``path`` must be readable on every executor (an installed vocabulary file).
    """

    def prepare():
        bpe = load(path, pattern)

        def apply(values: list) -> list:
            with _uncollected():
                ids = bpe.packed_all([v or "" for v in values])
            ends = np.cumsum([0, *map(len, ids)]) // 4
            flat = np.frombuffer(b"".join(ids), np.int32)
            found = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            return found + ([[bpe.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]] if decoded else [])

        return apply

    fields = [T.StructField(out, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    return with_row_columns(df, text, fields, prepare)


def decode(df: DataFrame, ids: str, path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each array of ids stands for; a null or empty array gives no bytes. An unknown id is an
    error. Rows are independent; a column named as ``out`` is replaced, the others stay; an empty table gives an empty one."""

    def prepare():
        bpe = load(path, pattern)
        return lambda values: [list(map(bpe.decode, values))]

    return with_row_columns(df, ids, [T.StructField(out, T.BinaryType())], prepare)
