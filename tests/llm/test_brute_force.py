"""The operators against plain versions of what they promise, on small inputs with every awkward case."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from corvane.llm import _graph, bpe, brown, chat, decontaminate, fingerprints, langid, lines, simhash, substrings, toxicity

RNG = random.Random(11)
AWKWARD = [None, "", " ", "\n\n", "a", "é" * 300, "x" * 5000, "word " * 3000, "The same text.\nTwice over.", "The same text.\nTwice over.", "日本語のテキスト 12 \U0001f600", "\x00\x1f control"]


def texts(n=40):
    words = ["alpha", "beta", "gamma", "delta", "der", "die", "ñandú", "l'eau", "12", "(x)"]
    out = [" ".join(RNG.choice(words) for _ in range(RNG.randint(1, 40))) + RNG.choice(["", "\n", ". End", "\tz"]) for _ in range(n)]
    out += [out[0], out[1] + "!", out[2].replace("alpha", "omega"), out[3] * 3]
    return AWKWARD + out


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated rows, a null id, clashing names, an unordered spread."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}") for i, t in enumerate(texts())]
    rows += [rows[-1], (None, "a text without an id", "de", "s1"), (None, None, None, None)]
    clash = ["token_ids", "n_words", "hit_items", "fingerprint_bits", "component_id", "lang_pred", "score", "toxicity", "offending", "decoded", "fingerprint", "_w", "block", "size"]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return frame.withColumns({c: F.lit("old") for c in clash})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# -- 1: lines -------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(text, n, letters="abcdefgh é"):
    out = list(text)
    for _ in range(n):
        at, kind = RNG.randint(0, len(out)), RNG.randint(0, 2)
        if kind == 0 or at == len(out):
            out.insert(at, RNG.choice(letters))
        elif kind == 1:
            del out[at]
        else:
            out[at] = RNG.choice(letters)
    return "".join(out)


def test_banded_distance():
    for _ in range(4000):
        a = "".join(RNG.choice("abé") for _ in range(RNG.randint(0, 14)))
        b = changed(a, RNG.randint(0, 4), "abé")
        assert [lines.within(a, b, d) for d in (1, 2, 3)] == [edits(a, b) <= d for d in (1, 2, 3)]


def test_probes_meet_all_pairs():
    for _ in range(4000):
        d = RNG.choice([1, 2, 3])
        a = "".join(RNG.choice("abcdefé") for _ in range(RNG.randint(2 * d + 1, 40)))
        b = changed(a, RNG.randint(0, d), "abcdefé")
        if edits(a, b) <= d < min(len(a), len(b)):
            of = [{(k, o) for k, o, *_ in lines.probes(x, d)} for x in (a, b)]
            assert any(k == j and (o or p) for k, o in of[0] for j, p in of[1])


def line_rows():
    base = ["".join(RNG.choice("abcdefgh é") for _ in range(RNG.randint(30, 60))).strip() for _ in range(10)]
    out = []
    for i in range(40):
        own = [changed(RNG.choice(base), RNG.randint(0, 4)) if RNG.random() < 0.6 else RNG.choice(["", "  ", "short", " " + RNG.choice(base) + "\t"]) for _ in range(RNG.randint(0, 7))]
        out.append((i, "\n".join(own)))
    short = ["".join(RNG.choice("abcdefgh é") for _ in range(RNG.randint(12, 36))).strip() for _ in range(8)]
    out += [(i, "\n".join(changed(RNG.choice(short), RNG.randint(0, 2)) for _ in range(4))) for i in range(70, 95)]
    out += [(i, "a common beginning of many lines " + "".join(RNG.choice("abcd") for _ in range(12))) for i in range(40, 70)]
    return out + [(100, None), (None, "short\nshort"), (101, "a\na"), (101, "a\na")]


def test_line_dedup(spark):
    rows, seen, want = line_rows(), [], []
    for i, text in sorted((i, t or "") for i, t in rows if i is not None):
        gone = []
        for k, line in enumerate(text.split("\n")):
            if line := line.strip(" \t\n\r\x0b\x0c"):
                limit = lambda x: lines.allowed(min(len(x), len(line)))  # noqa: B023, E731
                if any(x == line or (abs(len(x) - len(line)) <= limit(x) and edits(x, line) <= limit(x)) for x in seen):
                    gone.append(k)
                seen.append(line)
        want.append((i, gone))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).repartition(3)
    for block, hot in ((8 << 20, 1 << 15), (1200, 4)):
        found = lines.without_repeats(frame, "doc_id", "text", block_bytes=block, hot=hot, carry=("source",)).collect()
        assert sorted((r.doc_id, r.removed) for r in found if r.doc_id is not None) == sorted(want) and {r.source for r in found} == {"s"} and len(found) == len(rows)
        assert [r.kept for r in found if r.doc_id is None] == ["short\nshort"]


def test_crowded_segments():
    for group in (2, 4, 30):
        rows = [((0, i, 0), changed("abcdefghabcdefghabcd" + "xyz" * 5, RNG.randint(0, 5), "abcdxyz")) for i in range(25)]
        found = lines.later_alike([(p, "SEGMENT" + t, "\0" + t, True) for p, t in rows], 2, group)
        assert found == {p for k, (p, t) in enumerate(rows) if any(x != t and edits(x, t) <= 2 for _, x in rows[:k])}


def test_short_rests():
    for limit in (1, 2):
        for _ in range(150):
            rests = ["".join(RNG.choice("abc\0") for _ in range(RNG.randint(0, 7))) for _ in range(RNG.randint(2, 30))]
            members = [((0, i, 0), "SEGMENT" + t, t, True) for i, t in enumerate(rests)]
            out: set = set()
            lines._settle_short(members, limit, out)
            assert {p[1] for p in out} == {i for i, t in enumerate(rests) if any(x != t and edits(x, t) <= limit for x in rests[:i])}


def test_template_lines(spark):
    """Many lines of one template, within seconds; which of them go, by plain rules of the numbers in them."""
    numbers = RNG.sample(range(10**9), 20_000)
    names = ["Invoice number %09d of the company, payable within thirty days of the date of its receipt" % n for n in numbers]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(names)], "doc_id long, text string")
    began = time.monotonic()
    gone = {r.doc_id for r in lines.without_repeats(frame, "doc_id", "text").collect() if r.removed}
    assert time.monotonic() - began < 120
    sample = RNG.sample(range(len(names)), 60)
    digits = ["%09d" % n for n in numbers]
    for i in sample:
        near = any(sum(a != b for a, b in zip(digits[i], digits[j])) <= 2 or lines.within(digits[i], digits[j], 2) for j in range(i))
        assert (i in gone) == near


def test_awkward_lines(spark):
    long_line = "a long line without an end " * 20_000
    rows = [(1, long_line), (2, long_line + "x"), (3, "ok\n" + long_line[1:]), (4, ""), (5, None), (None, long_line), (6, long_line), (6, long_line)]
    clash = {c: F.lit("old") for c in ("block", "n_lines", "removed", "kept", "part", "key", "edits", "_id")}
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    found = sorted(((r.doc_id or 0, list(r.removed)) for r in lines.without_repeats(frame, "doc_id", "text").collect()))
    assert found == [(0, []), (1, []), (2, [0]), (3, [1]), (4, []), (5, []), (6, [0]), (6, [0])]
    assert lines.without_repeats(frame.where("false"), "doc_id", "text").collect() == []


def test_crowded_periodic_segments(spark):
    pair = ["abcdefg" + "-" * 18 + "hijklmn", "abXcdefg" + "-" * 18 + "hijkmn"]  # meet in the dashes only, at several starts
    crowd = ["".join(RNG.choices("opqrstuvwyz", k=7)) + "-" * 18 + "".join(RNG.choices("opqrstuvwyz", k=7)) for _ in range(lines.GROUP + 20)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*crowd, *pair])], "doc_id long, text string")
    assert [r.doc_id for r in lines.without_repeats(frame, "doc_id", "text").collect() if r.removed] == [len(crowd) + 1]


# -- 2: BPE ---------------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_equals_library(library):
    ranks, whole = library
    small = bpe.ByteBPE(ranks, public_tokenizers.PATTERN, leaf=3)
    parts = ["a", "the", " ", "  ", "\n", "'", "l", "L", "s", "1", "22", "é", "漢", "!", "..", "'ll", "'re", "aaaa", "\xa0", "\U0001f600", "²", "́", "<|endoftext|>"]
    for _ in range(2500):
        text = "".join(RNG.choice(parts) for _ in range(RNG.randint(0, 50)))
        ids = whole.encode_ordinary(text)
        assert small.encode(text) == ids and small.decode(ids).decode() == text
    own = bpe.load(PATH, public_tokenizers.PATTERN)
    for size in (1, 10, 64, 65, 1000, 100_000):  # one way at every size
        for text in ("a" * size, " " * size + "x", "the" * size, "=" * size, "word, " * size, "漢字" * size, "".join(RNG.choices("abcdefghij", k=size)), "".join(RNG.choices(parts, k=size))):
            ids = whole.encode_ordinary(text[:100_000])
            assert own.encode(text[:100_000]) == ids and own.decode(ids).decode() == text[:100_000]


def test_tree_uses_no_tokenizer_library():
    assert not {"tiktoken", "tokenizers"} & set(vars(bpe))


def test_ids_that_stay_apart_are_an_encoding(library):
    small = bpe.ByteBPE(library[0], public_tokenizers.PATTERN, leaf=4)
    for _ in range(3000):
        data = "".join(RNG.choice(["a", "aa", "the", "er", "in", "g", "é", "t"]) for _ in range(RNG.randint(2, 30))).encode()
        at = RNG.randint(1, len(data) - 1)
        packed = [np.array(small.merge(x), np.int32).tobytes() for x in (data[:at], data[at:])]
        assert np.frombuffer(small.seam(*packed), np.int32).tolist() == small.merge(data)
        ids, count = small._merged([data[:at], data, data[at:]])
        assert [row[:n].tolist() for row, n in zip(ids, count)] == [small.merge(x) for x in (data[:at], data, data[at:])]


def test_bpe_frames(docs, empty, library):
    found = bpe.decode(bpe.encode(docs, "text", PATH, public_tokenizers.PATTERN), "token_ids", PATH, public_tokenizers.PATTERN)
    rows = found.collect()
    assert len(rows) == docs.count() and all(r.token_ids == library[1].encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert bpe.encode(empty, "text", PATH, public_tokenizers.PATTERN).collect() == []


def test_leaves_end_at_rims_and_pieces_are_remembered(library, monkeypatch):
    ranks, whole = library
    own = bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    text = "it's the 1st thing, and 22 more. " * 40
    leaves = own.leaves(text)
    assert "".join(leaves) == text and len(leaves) > 8 and all(own.is_rim(a[-1] + b[0]) for a, b in zip(leaves, leaves[1:]))
    monkeypatch.setattr(bpe, "MEMORY", 50)
    merged = []
    monkeypatch.setattr(own, "_merged", lambda rows, f=own._merged: merged.extend(rows) or f(rows))
    words = [f" w{chr(97 + i // 26)}{chr(97 + i % 26)}qzx" for i in range(60)]
    for part in (words, ["!"], words):  # too many to be kept twice, but those of before are still at hand
        text = "".join(part)
        assert own.encode(text) == whole.encode_ordinary(text)
    assert len(merged) == len(set(merged)) > 50


def test_ascii_form_of_the_pattern():
    whole, ascii_ = regex.compile(public_tokenizers.PATTERN).findall, bpe._for_ascii(public_tokenizers.PATTERN)
    assert ascii_.__self__.pattern != public_tokenizers.PATTERN
    parts = [*map(chr, range(128)), *["'s", "'ll", " ", "  ", "a", "B", "1", "\n"] * 8]
    own = random.Random(3)
    for _ in range(5000):
        text = "".join(own.choices(parts, k=own.randint(0, 20)))
        assert ascii_(text) == whole(text)
    assert not any(map(bpe._for_ascii, (r"(?i:'s)|\p{L}+", r"\w+", r"\P{L}", r"[\S]", r"[[a]]", r"[^\r\n\p{L}]+")))


def test_decoded_on_the_way(docs, library):
    vocabulary = PATH, public_tokenizers.PATTERN
    rows = bpe.encode(docs, "text", *vocabulary, "ids", decoded="bytes").collect()
    assert len(rows) == docs.count() and all(r.ids == library[1].encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode() for r in rows)
    assert bpe.encode(docs, "text", *vocabulary, decoded="decoded").columns == [*(c for c in docs.columns if c not in ("token_ids", "decoded")), "token_ids", "decoded"]


# -- 3: chat --------------------------------------------------------------------------------------------------------


def test_escapes_and_masks():
    parts = ["<", "|", "\\", "s>", "/s>", "[", "INST]", "/INST]", chat.OPEN, chat.MIDDLE, chat.CLOSE, "a", " ", "<<SYS>>", "</s>", "[INST]", "\n", "é", "]"]
    for _ in range(3000):
        turns = [(RNG.choice(["user", "assistant", "<|", "x" + chat.MIDDLE, ""]), "".join(RNG.choice(parts) for _ in range(RNG.randint(0, 10)))) for _ in range(RNG.randint(0, 4))]
        formatted, mask = chat.render(turns)
        assert list(chat.parse(formatted)) == turns
        assert "".join(chat.unescape(formatted[a:b]) for a, b in mask) == "".join(t for r, t in turns if r == "assistant")
        assert not any(m in chat.escape(t) for _, t in turns for m in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


@pytest.mark.parametrize("record, name, turns", [
    ({"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, "messages", [("user", "q"), ("assistant", "")]), ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "speaker list", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]), ({"instruction": "i", "input": "x", "output": "o", "system": "s"}, "instruction", [("system", "s"), ("user", "i"), ("user", "x"), ("assistant", "o")]),
    ({"prompt": "p", "response": "r"}, "prompt", [("user", "p"), ("assistant", "r")]), ({"prompt": "p", "completion": 3}, "completion", [("user", "p"), ("assistant", "3")]), ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
    ({"data": {"messages": [{"role": "model", "content": "a"}]}}, "nested data", [("model", "a")]), ({"messages": [{"role": "human", "content": "q"}, {"role": "gpt", "content": "a"}]}, "messages", [("human", "q"), ("gpt", "a")]), ({"dialogue": [{"speaker": "bot", "utterance": "u"}]}, "dialogue", [("bot", "u")]), ({"messages": []}, "messages", []), ({"foo": 1}, None, None), ([], None, None), ({"messages": "text"}, None, None),
])
def test_layouts(record, name, turns):
    assert chat.turns_of(record) == (None if name is None else (name, turns))


def test_common_marks_are_escaped():
    for mark in ("<|im_start|>", "<s>", "</s>", "<<SYS>>", "[INST]", "[/INST]", "[TOOL_CALLS]", "<unk>", "<pad>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>"):
        for text in (mark, "a" + mark * 2, mark[0] + "\\" + mark[1:], mark[0] + mark):
            assert mark not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_chat_frames(spark, empty):
    long_text = "<s> word [INST] " * 50_000
    rows = [(1, 1, "assistant", "a"), (1, 0, "user", None), (1, 0, "user", None), (None, 0, None, "x"), (None, 1, "human", "y"), (2, None, "user", "</s>"), (3, 0, "gpt", long_text), (3, 0, "gpt", long_text)]
    rows += [(4, 0, "user", ""), (4, 1, "assistant", "b"), (9, 0, "system", "s"), (9, 1, "user", "q"), (9, 2, "assistant", None), (14, 0, "user", "q"), (14, 1, "human", "b"), (7, 0, "user", "q")]
    frame = spark.createDataFrame(rows, "c long, t long, r string, x string").withColumns({c: F.lit("old") for c in ("conv_id", "record", "m", "turns")})
    formatted = chat.format_records(chat.gathered(frame, "c", "t", "r", "x"), "record").withColumns({"turns": F.lit("old"), "loss_text": F.lit("old"), "source": F.lit("kept")})
    all_rows = chat.masked_text(chat.read_back(formatted)).collect()
    found = {r.conv_id: r for r in all_rows if r.conv_id is not None}
    by_id = collections.defaultdict(list)
    for c, t, r, x in rows:
        by_id[c].append((t is not None, t, r or "", x or ""))
    for c, own in by_id.items():
        if c is not None:
            want = [(r, x) for _, _, r, x in sorted(own)]
            assert [tuple(t) for t in found[c].turns] == want and found[c].loss_text == "".join(x for r, x in want if r == "assistant") and found[c].source == "kept"
    assert {c: r.layout for c, r in found.items()} == {1: "message texts", 2: "dialogue", 3: "nested data", 4: "prompt", 9: "prompt", 14: "messages", 7: "dialogue"}
    assert sorted([tuple(t) for t in r.turns] for r in all_rows if r.conv_id is None) == [[("", "x")], [("human", "y")]]
    bad = spark.createDataFrame([("{",), (None,), ('{"x": 1}',)], "record string")
    assert [r.formatted for r in chat.format_records(bad, "record").collect()] == [None] * 3
    assert chat.masked_text(chat.read_back(chat.format_records(bad.where("false"), "record"))).collect() == []
    assert chat.gathered(frame.where("false"), "c", "t", "r", "x").collect() == []


# -- 4: SimHash -----------------------------------------------------------------------------------------------------


def plain_print(text):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, radius=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_masks_cover():
    for _ in range(2000):
        x = sum(1 << b for b in RNG.sample(range(64), RNG.randint(0, 2)))
        assert any(x & m == 0 for m in simhash.masks())


def test_near_duplicates(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [plain_print(t) for _, t in rows]
    roots = linked(prints)
    least = {r: min((i for (i, _), x in zip(rows, roots) if x == r and i is not None), default=None) for r in roots}
    found = simhash.near_duplicates(docs, "doc_id", "text").collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.fingerprint_bits % (1 << 64), r.component_id) for r in found), key=key) == sorted(((i, p, least[r]) for (i, _), p, r in zip(rows, prints, roots)), key=key)
    assert simhash.near_duplicates(empty, "doc_id", "text").collect() == []


def test_links_of_close_prints(spark):
    base = [RNG.getrandbits(64) for _ in range(4)]
    prints = [RNG.choice(base) ^ sum(1 << b for b in set(RNG.choices(range(64), k=RNG.randint(0, 5)))) for _ in range(400)]
    frame = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "i int, p long")
    found = {r.node: r.root for r in _graph.components(simhash.links(frame, "p")).collect()}
    groups = collections.defaultdict(set)
    for p, r in zip(prints, linked(prints)):
        groups[r].add(p)
    mine = collections.defaultdict(set)
    for p in set(prints):
        s = p - (1 << 64) if p >> 63 else p
        mine[found.get(s, s)].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_components_of_a_chain(spark):
    frame = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (500, 502)], "a long, b long").repartition(3)
    assert {r.node: r.root for r in _graph.components(frame).collect()} == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 500}


# -- 5: substrings --------------------------------------------------------------------------------------------------


def removed(rows, length):
    first = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            first[t[k : k + length]] = min(first.get(t[k : k + length], i), i)
    out = []
    for i, t in rows:
        mask = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                mask[k : k + length] = True
        out.append((i, bytes(np.frombuffer(t, np.uint8)[~mask]), int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())))
    return sorted(out)


def test_backward_extension():
    for _ in range(60):
        length, letters = RNG.choice([3, 5, 8, 50]), RNG.choice([b"ab", b"abc\0", bytes(range(256))])
        base, docs_ = bytes(RNG.choice(letters) for _ in range(80)), []
        for i in range(RNG.randint(1, 10)):
            at = RNG.randint(0, 60)
            docs_.append((i, bytes(RNG.choice(letters) for _ in range(RNG.randint(1, 60))) + base[at : at + RNG.randint(0, 70)]))
        gone = {i: set() for i, _ in docs_}
        for which, start, end in substrings.repeated([t for _, t in docs_], np.arange(len(docs_)), length):
            gone[which] |= set(range(start, end))
        assert sorted((i, bytes(x for k, x in enumerate(t) if k not in gone[i])) for i, t in docs_) == [r[:2] for r in removed(docs_, length)]


def test_substring_dedup(spark):
    line = "One line of more than fifty bytes that many documents of the table share, with é in it."
    rows = [(i, t) for i, t in enumerate(texts(20))] + [(200 + k, "a" * RNG.randint(0, 300) + "xyz" * RNG.randint(0, 50)) for k in range(15)]
    rows += [(300 + k, "".join(RNG.choice("abcdefgh") for _ in range(40)) + line + "".join(RNG.choice("abcdefgh") for _ in range(40))) for k in range(25)] + [(301, line), (301, line)]
    plain = [(i, (t or "").encode()) for i, t in rows]
    frame = spark.createDataFrame([*rows, (None, line)], "doc_id long, text string").repartition(3)
    for block, hot in ((8 << 20, 1 << 15), (20_000, 3)):
        found = substrings.without_repeats(frame, "doc_id", "text", block_bytes=block, hot=hot).collect()
        assert sorted((r.doc_id, bytes(r.kept), len(r.removed)) for r in found if r.doc_id is not None) == removed(plain, 50)
        assert [bytes(r.kept).decode() for r in found if r.doc_id is None] == [line]
    assert substrings.without_repeats(frame.where("false"), "doc_id", "text").collect() == []


# -- 6: language model ----------------------------------------------------------------------------------------------


def test_brown(docs, empty):
    train = docs.where("doc_id % 3 <> 0")
    counts = collections.Counter()
    for r in train.collect():
        counts.update([*brown.words(r.text), None])
    total, types = sum(counts.values()), len(counts)
    for known in (1000, 3):  # 3: most words are joined
        model = brown.fit(train, "text", clustered=6, classes=3, known=known)
        assert (model.tokens, model.types) == (total, types)
        found = brown.score(docs, "text", model).collect()
        texts_ = collections.defaultdict(list)
        for r in docs.collect():
            texts_[r.doc_id].append(r.text)
        assert len(found) == docs.count()
        for r in found:
            if len(texts_[r.doc_id]) == 1 or r.doc_id is not None:
                own = [*brown.words(texts_[r.doc_id][0]), None]
                assert (r.n_tokens, r.n_known) == (len(own), sum(counts[w] > 0 for w in own)) and math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in own), rel_tol=1e-9) and r.score <= 0
        by_id = {r.doc_id: r.score for r in found if r.doc_id is not None}
        if known == 1000:
            first = by_id
    assert all(math.isclose(first[i], s, rel_tol=0.2, abs_tol=3) for i, s in by_id.items())
    nothing = brown.fit(empty, "text")
    assert (nothing.tokens, nothing.types) == (0, 0) and all(r.base_score == 0 and r.n_known == 0 for r in brown.score(docs, "text", nothing).collect())


def test_a_word_class_is_a_distribution(docs):
    model = brown.fit(docs, "text", clustered=6, classes=3)
    assert np.allclose((10.0**model.transitions).sum(1), 1)
    for k in range(max(model.classes[:6]) + 1):
        assert math.isclose(sum(10.0 ** model.emissions[:6][model.classes[:6] == k]), 1) or not (model.classes[:6] == k).any()


def test_exchange_finds_classes():
    bigrams = np.zeros((7, 7))
    for a in (0, 2, 4):
        for b in (1, 3, 5):
            bigrams[a, b] = bigrams[b, a] = 10
    bigrams[6, 6] = 1
    of = brown.exchange(bigrams, 6, 2)
    assert len({*of[[0, 2, 4]]}) == len({*of[[1, 3, 5]]}) == 1 and of[0] != of[1]


def test_gains_are_those_of_the_likelihood():
    classes, seeds, size = 4, 12, 6  # two further classes, of the words 12 to 29
    rng = np.random.default_rng(5)
    bigrams = rng.poisson(0.7, (30, 30)).astype(float)
    of = np.concatenate((np.arange(seeds) % classes, classes + np.arange(30 - seeds) % 2))

    def table(of):
        return np.eye(size)[of].T @ bigrams @ np.eye(size)[of]

    def likelihood(of):
        t = table(of)
        return brown._f(t).sum() - brown._f(t.sum(0)).sum() - brown._f(t.sum(1)).sum()

    rows = [(w, c, bigrams[w, x] if d == 0 else bigrams[x, w]) for w in range(seeds, 30) for x in range(30) for d, c in ((0, of[x]), (1, size + of[x])) if x != w]
    rows += [(w, 2 * size, bigrams[w, w]) for w in range(seeds, 30)]
    counts = collections.Counter()
    for w, c, n in rows:
        counts[w - seeds, c] += n
    word, context = np.array(sorted(counts)).T
    found = brown.gains(table(of), classes, of[seeds:], word, context, np.array([counts[k] for k in sorted(counts)]))
    for w in range(seeds, 30):
        want = np.array([likelihood(np.concatenate((of[:w], [c], of[w + 1 :]))) for c in range(classes)])
        assert np.allclose(found[w - seeds] - found[w - seeds][0], want - want[0])


def test_all_repeated_words_are_classed(docs):
    train = docs.where("doc_id % 3 <> 0")
    counts = collections.Counter(w for r in train.collect() for w in brown.words(r.text))
    scores = []
    for known in (1000, 3):  # where a class is looked up changes nothing
        model = brown.fit(train, "text", classes=2, seeds=3, known=known)
        of = dict(zip(model.known, model.classes.tolist())) | {r.word.encode(): r["class"] for r in model.vocabulary.collect()}
        assert len(model.known) <= known and of.keys() == counts.keys()
        assert all((c < 2) == (counts[w] > 1) and (c < 2 or c == 2 + brown.shape(w)) for w, c in of.items()) and sum(c < 2 for c in of.values()) > 3
        assert all(model.sizes[c] == sum(counts[w] for w in of if of[w] == c) for c in range(2)) and np.allclose((10.0**model.transitions).sum(1), 1)
        table = np.zeros((len(model.sizes),) * 2)
        for r in train.collect():
            path = [len(table) - 1, *(of[w] for w in brown.words(r.text)), len(table) - 1]
            np.add.at(table, (path[:-1], path[1:]), 1)
        overall = (table.sum(0) + 1) / (table.sum() + len(table))
        assert np.allclose(10.0**model.transitions, (table + brown.PRIOR * overall) / (table.sum(1, keepdims=True) + brown.PRIOR))
        scores.append({r.doc_id: r.score for r in brown.score(docs, "text", model).collect() if r.doc_id is not None})
        for r in docs.where("doc_id IS NOT NULL").collect():
            own = brown.words(r.text)
            path = [len(table) - 1, *(of.get(w, 2 + brown.shape(w)) for w in own), len(table) - 1]
            want = sum(model.transitions[a, b] for a, b in zip(path, path[1:])) + sum(math.log10((counts[w] + (c > 1)) / model.sizes[c]) for w, c in zip(own, path[1:]))
            assert math.isclose(scores[-1][r.doc_id], want, rel_tol=1e-9, abs_tol=1e-9)
    assert all(math.isclose(s, scores[1][i], rel_tol=1e-9) for i, s in scores[0].items())


def test_words_by_column():
    own = random.Random(6)
    parts = ["A", "b", "é", "É", "Ж", " ", " ", "\t", "\x0b", "\x1c", "\x85", "\xa0", "1", "-", "日", "\x00", "\x7f"]
    texts = [None, "", " ", " a", "a ", "  A B\tc\x0b\x0cd\r\ne "] + ["".join(own.choices(parts, k=own.randint(0, 30))) for _ in range(3000)]
    for column in (pa.array(texts), pa.array(["z y", *texts, "q"]).slice(1, len(texts)), pa.array([], pa.string()), pa.array([None], pa.string())):
        found, sizes = brown.split(column)
        want = [brown.words(t) for t in column.to_pylist()]
        flat = [w for own in want for w in own]
        assert found.cast(pa.binary()).to_pylist() == flat and sizes.tolist() == list(map(len, want))
        assert brown.shapes(found).tolist() == [brown.shape(w) for w in flat] and brown.shapes(found.slice(5)).tolist() == [brown.shape(w) for w in flat[5:]]
        places = {w: i for i, w in enumerate(sorted(set(flat))[::2])}
        assert brown.codes(found, places).tolist() == [places.get(w, len(places) + brown.shape(w)) for w in flat]


def test_shapes_agree(spark):
    words = ["a", "abcdef", "abcdefghijk", "é", "éabcdef", "a.", "é.", "12", "a1", "--", "a-", "日本"]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.s for r in frame.select(brown._shape_of(F.col("w")).alias("s")).collect()] == [brown.shape(w.encode()) for w in words]


# -- 7: winnowing ---------------------------------------------------------------------------------------------------


def test_winnow(spark):
    rows = [(k, [RNG.randint(0, 5) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 3, 4, 5, 9, 40, 40])]
    frame = spark.createDataFrame(rows, "k int, g array<long>")
    for window in (1, 2, 4, 5):
        for r in frame.select("g", fingerprints.winnow(F.col("g"), window).alias("p")).collect():
            want = []
            for s in range(max(1, len(r.g) - window + 1) if r.g else 0):
                part = r.g[s : s + window]
                at = s + max(i for i, x in enumerate(part) if x == min(part))
                want += [at] if at not in want else []
            assert r.p == want


M64 = (1 << 64) - 1


def plain_fingerprint(text, k=5, window=4):
    """Hashes and places, with each k-gram hashed by itself."""
    own = [w[i : i + 12] for w in re.findall(r"[^\x09-\x0D ]+", text or "") for i in range(0, len(w), 12)]
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in own]
    turned = lambda x, n: (x << n | x >> (64 - n)) & M64
    grams = []
    for i in range(max(1, len(own) - k + 1) if own else 0):
        g = 0
        for j, h in enumerate(hashed[i : i + k]):
            g ^= turned(h, k - 1 - j) if k - 1 - j else h
        grams.append(g - (1 << 64) if g >> 63 else g)
    places = []
    for s in range(max(1, len(grams) - window + 1) if grams else 0):
        part = grams[s : s + window]
        at = s + max(i for i, x in enumerate(part) if x == min(part))
        places += [at] if at not in places[-1:] else []
    return [grams[p] for p in places], places


def test_rolled_fingerprints(spark, docs):
    rows = [(r.text,) for r in docs.collect()] + [(" ".join(RNG.choice("abc") for _ in range(n)),) for n in (1, 4, 5, 6, 8, 63, 64, 65, 68, 69, 70, 128, 129, 133, 700)] + [("word " * 40_000,)]
    frame = spark.createDataFrame(rows, "text string")
    for r in fingerprints.with_fingerprint(frame, "text", "f").collect():
        assert (list(r.f.hashes), list(r.f.places)) == plain_fingerprint(r.text)
    for k, window in ((1, 1), (3, 7)):
        for r in fingerprints.with_fingerprint(frame.limit(60), "text", "f", k, window).collect():
            assert (list(r.f.hashes), list(r.f.places)) == plain_fingerprint(r.text, k, window)


def test_shared_runs_have_a_common_hash(spark):
    """The guarantee of winnowing: k + window - 1 words in common, wherever they stand."""
    word = lambda: "".join(RNG.choices("abcdefgh", k=RNG.randint(1, 9)))
    rows = []
    for _ in range(200):
        run = [word() for _ in range(fingerprints.K + fingerprints.WINDOW - 1)]
        rows.append(tuple(" ".join([word() for _ in range(RNG.randint(0, 30))] + run + [word() for _ in range(RNG.randint(0, 30))]) for _ in range(2)))
    frame = fingerprints.with_fingerprint(fingerprints.with_fingerprint(spark.createDataFrame(rows, "a string, b string"), "a", "fa"), "b", "fb")
    for r in frame.select("fa", "fb", fingerprints.likeness(F.col("fa"), F.col("fb")).alias("x")).collect():
        a, b = set(r.fa.hashes), set(r.fb.hashes)
        assert a & b and math.isclose(r.x, len(a & b) / len(a | b))


def test_next_documents(docs, empty):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] if r[0] is not None else signed(r[1])), r[1].encode()))
    want = sorted((i is not None, i or 0, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    for size in (8 << 20, 2000):
        found = fingerprints.with_next(docs, "doc_id", "text", range_bytes=size).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.next_text) for r in found) == want
    assert fingerprints.with_next(empty, "doc_id", "text").collect() == []


def test_other_columns_stay(docs):
    found = fingerprints.with_fingerprint(docs, "text", "fingerprint")
    assert found.where("_w = 'old' AND block = 'old'").count() == docs.count() and "hashes" in found.select("fingerprint.*").columns
    for made in (bpe.encode(docs, "text", PATH, public_tokenizers.PATTERN), toxicity.score(docs, "text", toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -9.0)), langid.predict(docs, "text", {})):
        assert set(docs.columns) <= set(made.columns) and made.where("_w = 'old'").count() == docs.count()


def test_equal_texts_and_likeness(docs):
    found = fingerprints.with_fingerprint(docs.select("doc_id", "text"), "text", "f").collect()
    by_text = collections.defaultdict(set)
    for r in found:
        by_text[r.text or ""].add((tuple(r.f.hashes), tuple(r.f.places)))
    assert all(len(x) == 1 for x in by_text.values())
    same = docs.select("text").transform(lambda d: fingerprints.with_fingerprint(d, "text", "f")).select(fingerprints.likeness(F.col("f"), F.col("f")).alias("x"))
    assert {r.x for r in same.collect()} == {1.0}


# -- 8: decontamination ---------------------------------------------------------------------------------------------


def test_decontamination_keeps_empty_ids_and_leaves_out_null_ones():
    finder = decontaminate.WuManber([("", "alpha beta"), (None, "gamma")])
    assert finder.search(decontaminate.words("alpha beta gamma")) == ([(0, 3)], {""})


def test_decontamination(spark, docs):
    items = [(1, "alpha beta gamma delta der die alpha beta gamma delta der die"), (2, "12 x"), (3, ""), (4, None), (5, "ñandú"), (None, "l eau"), (1, "omega omega"), (6, " ".join(texts()[20].split()[:15]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        own = decontaminate.words(t)
        for k in range(max(1, len(own) - 9) if own else 0):
            windows[tuple(own[k : k + 10])].add(i)
    for size in (8 << 20, 30):
        for r in decontaminate.decontaminate(docs, "text", bench, "item_id", "text", pass_bytes=size).collect():
            own, hit, ids = decontaminate.words(r.text), set(), set()
            for w, owners in windows.items():
                for k in range(len(own) - len(w) + 1):
                    if tuple(own[k : k + len(w)]) == w:
                        hit |= set(range(k, k + len(w)))
                        ids |= {str(i) for i in owners if i is not None}
            assert r.n_words == len(own) and {x for s in r.hit_spans for x in range(s.start, s.end)} == hit and r.hit_items == sorted(ids)


# -- 9, 10: classifiers ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def crc(column, n):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def test_language_accuracy(corpus):
    train, held = corpus[0].where(crc("doc_id", 4) != 2), corpus[0].where((crc("doc_id", 4) == 2) & (F.char_length("text") > 40))
    found = langid.predict(held, "text", langid.fit(train, "text", "lang", "doc_id")).collect()
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.97 and all(0 <= r.score <= 1 for r in found)


def test_language_prediction_is_the_nearest_profile(docs):
    """Fit and prediction against plain sums over the n-grams of each text."""

    def bundle(text):
        letters = [0]
        for c in (text or "").lower() + " ":
            code = ord(c) if c.isalpha() else 0
            if code or letters[-1]:
                letters.append(code)
        letters += [0] if letters[-1] else []
        if len(letters) < 3:
            return None
        return sum(np.roll(langid._vector(a), 2) * np.roll(langid._vector(b), 1) * langid._vector(c) for a, b, c in zip(letters, letters[1:], letters[2:])).astype(float)

    train = [(f"t{i}", " ".join(RNG.choices(w, k=12)), lang) for lang, w in (("aa", ["alpha", "beta", "gamma"]), ("bb", ["der", "die", "das"]), ("cc", ["uno", "dos", "ñandú"])) for i in range(5)]
    frame = docs.sparkSession.createDataFrame(train, "id string, text string, lang string")
    sums = {lang: sum(bundle(t) / np.linalg.norm(bundle(t)) for _, t, x in train if x == lang) for lang in ("aa", "bb", "cc")}
    unit = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    middle = sum(unit.values()) / 3
    want = {k: (v - middle) / np.linalg.norm(v - middle) for k, v in unit.items()}
    prototypes = langid.fit(frame, "text", "lang", "id")
    assert prototypes.keys() == want.keys() and all(np.allclose(prototypes[k], want[k], atol=1e-5) for k in want)
    for r in langid.predict(docs, "text", prototypes).collect():
        own = bundle(r.text)
        if own is None:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cosine = {k: float(v @ own / (np.linalg.norm(own) or 1)) for k, v in want.items()}
        best = max(cosine.values())
        assert cosine[r.lang_pred] > best - 1e-5 and math.isclose(r.score, 1 / sum(math.exp(langid.SHARP * (c - best)) for c in cosine.values()), rel_tol=1e-3)


def test_language_edges(docs, empty, corpus):
    prototypes = langid.fit(corpus[0], "text", "lang", "doc_id", bound=300)
    found = {r.doc_id: r for r in langid.predict(docs, "text", prototypes).collect() if r.doc_id is not None}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2, 3)) and found[9].lang_pred != "und"
    assert langid.fit(empty, "text", "lang", "doc_id") == {} and {r.lang_pred for r in langid.predict(docs, "text", {}).collect()} == {"und"}


def test_bundling_is_the_sum_of_bound_vectors():
    bundler, text = langid.Bundler(), "ab ab"
    codes = [0, 97, 98, 0, 97, 98, 0]
    want = sum(np.roll(langid._vector(a), 2) * np.roll(langid._vector(b), 1) * langid._vector(c) for a, b, c in zip(codes, codes[1:], codes[2:]))
    assert np.allclose(bundler.bundle(text), want)


def test_toxicity_accuracy_and_places(corpus):
    docs_, labels = corpus
    model = toxicity.fit(docs_, "doc_id", "text", labels, "doc_id", "toxic", lambda c: crc(c, 3) != 1)
    held = docs_.join(labels, "doc_id").where(crc("doc_id", 3) == 1)
    found = toxicity.score(held, "text", model).collect()
    ranks = [(a.toxicity > b.toxicity) + (a.toxicity == b.toxicity) / 2 for a in found if a.toxic for b in found if not b.toxic]
    assert np.mean(ranks) > 0.9 and all(0 <= r.toxicity <= 1 for r in found)
    for r in found:
        assert all(0 <= s.start < s.end <= len(r.text) and s.score > 0.5 for s in r.offending)


def test_scores_are_noisy_or_of_sentences(docs):
    rng = np.random.default_rng(4)
    weights, bias = np.maximum(rng.normal(0, 1, 1 << toxicity.BITS), 0).astype(np.float32), -4.0
    for r in toxicity.score(docs, "text", toxicity.Model(weights, bias), above=0.2).collect():
        p = []
        for m in [m for m in re.finditer(r"[^.!?\n]{1,400}", r.text or "")] or [None]:
            own = {w for w in re.findall(r"[^\W\d_]+", m[0].lower())} if m else set()
            p.append((m.start() if m else 0, m.end() if m else 0, 1 / (1 + math.exp(-bias - sum(float(weights[f]) for w in own for f in toxicity.features(w))))))
        assert math.isclose(r.toxicity, 1 - math.prod(1 - x for _, _, x in p), rel_tol=1e-4, abs_tol=1e-6)
        assert [(s.start, s.end) for s in r.offending] == [(a, b) for a, b, x in p if x > 0.2]


def test_training_climbs_the_likelihood_of_labels():
    """The slope that training follows, by differences of the likelihood; and what it finds: the one telling word."""
    rng = np.random.default_rng(9)
    sentences_of, labels = rng.integers(1, 5, 60), rng.integers(0, 2, 60)
    words_of = rng.integers(2, 7, sentences_of.sum())
    feats, bad = rng.integers(10, 60, words_of.sum()), 5
    first_word = np.concatenate(([0], np.cumsum(words_of)[:-1]))
    offending = np.concatenate(([0], np.cumsum(sentences_of)[:-1]))  # the first sentence of each toxic document
    feats[first_word[offending[labels == 1]]] = bad
    model = toxicity.train(feats, words_of, sentences_of, labels)
    assert model.weights.min() >= 0 and model.weights.argmax() == bad and model.weights[bad] > 2 * np.sort(model.weights)[-2]

    def likelihood(weights, bias):
        z = bias + np.add.reduceat(weights[feats], first_word)
        harmless = np.multiply.reduceat(1 - 1 / (1 + np.exp(-z)), offending)
        return np.log(np.where(labels == 1, 1 - harmless, harmless)).sum()

    start = likelihood(np.zeros(1 << toxicity.BITS), toxicity.START)
    assert likelihood(model.weights.astype(float), model.bias) > start + 50


def test_long_documents_are_learnt_from(spark):
    rows = [(i, "plain words here. " * 600 + ("a vile thing. " if i % 2 else "a nice thing. "), i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame, "doc_id", "text", frame, "doc_id", "toxic")
    assert {(r.toxic, r.toxicity > 0.5) for r in toxicity.score(frame, "text", model).collect()} == {(0, False), (1, True)}


def test_toxicity_edges(docs, empty, corpus):
    none = toxicity.fit(docs, "doc_id", "text", corpus[1].where("false"), "doc_id", "toxic")
    assert all(r.toxicity < 0.5 and r.offending == [] for r in toxicity.score(docs, "text", none).collect())
    assert toxicity.score(empty, "text", none).collect() == []


# -- the queries ----------------------------------------------------------------------------------------------------


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def awkward_folder(docs, tmp_path_factory, spark):
    folder = str(tmp_path_factory.mktemp("awkward"))
    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))
    rows.write.parquet(f"{folder}/documents.parquet")
    for name in ("benchmark", "labels", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_queries_on_awkward_tables(spark, awkward_folder):
    from corvane.llm.queries import QUERIES

    texts_ = {r.doc_id: r.text for r in spark.read.parquet(f"{awkward_folder}/documents.parquet").collect()}
    found = {name: f(spark, awkward_folder).collect() for name, f in QUERIES.items()}
    for name, rows in found.items():
        if name != "op3_chat_format":
            assert sorted(r.doc_id for r in rows) == sorted(texts_), name
    order = sorted(texts_, reverse=True)
    for r in found["op7_winnowing"]:
        own, other = texts_[r.doc_id] or "", texts_[order[(order.index(r.doc_id) + 1) % len(order)]] or ""
        n = len(own) // 3
        assert r.n_chars == len(own) and r.edited_sha256 == sha(own[: len(own) - n] + other[:n])
        prints = [plain_fingerprint(t) for t in (own, own[: len(own) - n] + other[:n], other)]
        alike = [len({*a[0]} & {*b[0]}) / len({*a[0]} | {*b[0]}) if a[0] or b[0] else 1.0 for a, b in ((prints[0], prints[1]), (prints[0], prints[2]))]
        assert math.isclose(r.near_edited, alike[0]) and math.isclose(r.near_next, alike[1])
        assert [r.fingerprint, r.edited_fingerprint] == [sha(" ".join(map(str, p[0])) + "|" + " ".join(map(str, p[1]))) for p in prints[:2]]
    for r in found["op6_brown_lm"]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert {r.conv_id for r in found["op3_chat_format"]} >= {-1}


# -- ranges ---------------------------------------------------------------------------------------------------------


def test_ranges_are_balanced_wherever_ids_stand(spark):
    from corvane.llm import _common

    for ids in (range(3000), [*range(3000), 1 << 62, -(1 << 62)], [*range(0, 1500), *range(10**15, 10**15 + 1500)], [k * 10**12 for k in range(3000)], [*range(2900), *[7] * 100], [5]):
        frame = spark.createDataFrame([(i, "x" * 100) for i in ids], "id long, text string").repartition(3)
        found, n = _common.ranged(frame, "id", "text", 10_000, "part")
        rows = sorted((r.id, r.part) for r in found.collect())
        of = collections.defaultdict(set)
        for i, p in rows:
            of[i].add(p)
        assert len(rows) == len(list(ids)) and all(len(p) == 1 for p in of.values()) and [p for _, p in rows] == sorted(p for _, p in rows)
        sizes = collections.Counter(p for _, p in rows)
        assert set(sizes) == set(range(n)) and max(sizes.values()) <= 310 and found.columns == ["id", "text", "part"]


def test_rows_without_ids_are_spread(spark):
    rows = [(None, f"text {i % 200} " * 20) for i in range(400)] + [(i, f"own {i} " * 20) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = fingerprints.with_next(frame, "doc_id", "text", range_bytes=3000)
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0) if r[0] is not None else -signed(r[1]), r[1]))
    want = sorted((i is not None, i or 0, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.next_text) for r in found.collect()) == want


def test_far_ids_change_nothing(spark):
    shared = "One line of more than fifty bytes that many documents of the table share, always the same."
    rows = [(i, f"{i} " * 30 + "\n" + shared) for i in range(60)]
    far = [((1 << 61) + i, t) for i, t in rows]
    for made in (lambda d: lines.without_repeats(d, "doc_id", "text", block_bytes=2000), lambda d: substrings.without_repeats(d, "doc_id", "text", block_bytes=2000)):
        kept = [sorted((r.doc_id & 0xFF, r.kept) for r in made(spark.createDataFrame(x, "doc_id long, text string")).where("doc_id <> -5").collect()) for x in (rows, far, [*rows[:30], *far[30:]])]
        assert kept[0] == kept[1] == kept[2]
