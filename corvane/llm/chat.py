"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

A record's nested field paths are hashed; the hash looks up a mapping, which says where turns, roles and texts stand
in records of that layout. Mappings list the paths that a layout must have and those that it may have, so every
fingerprint that a mapping answers to is known beforehand, and an unknown one is reported, not guessed.

The template marks each turn; strings in roles and texts that a template or tokenizer would take for a mark get a
backslash behind their first character (one more where there are some), which is undone when reading back.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm._common import with_row_columns

Turn = tuple[str, str]

# -- layouts ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """``turns``: (role, path) pairs in order; a role that starts with "=" is a path beside the text's path in the same list.

    ``roles`` renames roles. Paths of list items have "[]"; ``optional`` paths may be missing.
    """

    name: str
    turns: tuple[tuple[str, str], ...]
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> list[str]:
        return sorted({p for role, path in self.turns for p in ([role[1:], path] if role[0] == "=" else [path])})


#: What one layout calls those whom all others call user and assistant; elsewhere roles stay as they are.
_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

MAPPINGS = (
    Mapping("messages", (("=messages[].role", "messages[].content"),)),
    Mapping("message texts", (("=messages[].role", "messages[].text"),)),
    Mapping("speaker list", (("system", "system"), ("=conversations[].from", "conversations[].value")), ("system",), _SPEAKERS),
    Mapping("dialogue", (("=dialogue[].speaker", "dialogue[].utterance"),)),
    Mapping("prompt", (("system", "system"), ("user", "prompt"), ("assistant", "response")), ("system",)),
    Mapping("completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), ("system",)),
    Mapping("question", (("user", "context"), ("user", "question"), ("assistant", "answer")), ("context",)),
    Mapping("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), ("system", "input")),
    Mapping("nested data", (("=data.messages[].role", "data.messages[].content"),)),
)


def paths_of(value, at: str = "") -> set[str]:
    """The paths of a record's scalar fields; list items share theirs, and empty lists have that of the list."""
    if isinstance(value, dict):
        return set().union(*(paths_of(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths_of(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint_of(paths: Iterable[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)))


@functools.cache
def _index() -> tuple[dict[int, Mapping], frozenset[str]]:
    index: dict[int, Mapping] = {}
    for mapping in MAPPINGS:
        needed = [p for p in mapping.paths() if p not in mapping.optional]
        for n in range(len(mapping.optional) + 1):
            for extra in itertools.combinations(mapping.optional, n):
                index.setdefault(fingerprint_of([*needed, *extra]), mapping)
    return index, frozenset(p for m in MAPPINGS for p in m.paths())


def _values(record, path: str) -> list:
    found = [record]
    for step in path.replace("[]", ".[]").split("."):
        if step == "[]":
            found = [x for f in found if isinstance(f, list) for x in f]
        else:
            found = [f.get(step) if isinstance(f, dict) else None for f in found]
    return found


def turns_of(record) -> tuple[str, list[Turn]] | None:
    """The mapping's name and the canonical turns; None for a layout that no mapping answers to.

    Fields that no mapping knows (ids, sources) don't count for the fingerprint. A null or missing text is empty.
    """
    index, known = _index()
    found = {p for p in paths_of(record) if p in known}
    mapping = index.get(fingerprint_of(found))
    if mapping is None and isinstance(record, dict):  # an empty list of turns has no paths of items
        mapping = next((m for m in MAPPINGS if not found and any(record.get(p.split("[]")[0]) == [] for p in m.paths() if "[]" in p)), None)
    if mapping is None:
        return None
    turns: list[Turn] = []
    for role, path in mapping.turns:
        texts = _values(record, path)
        roles = _values(record, role[1:]) if role[0] == "=" else [role] * len(texts)
        if role[0] != "=" and path in mapping.optional and texts == [None]:
            continue
        turns += [(mapping.roles.get(_text(r), _text(r)), _text(t)) for r, t in zip(roles, texts)]
    return mapping.name, turns


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


# -- template -----------------------------------------------------------------------------------------------------

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: What texts may not hold plainly: our marks and those of common templates. After "<" or "[" and any backslashes.
_MARK = (
    r"(?=\||/?s>|/?SYS>|unk>|pad>|mask>|[be]os>|start_of_turn>|end_of_turn>"  # <|...|>, <s>, <<SYS>>, <start_of_turn>
    r"|/?INST\]|/?TOOL_CALLS\]|/?TOOL_RESULTS\]|/?AVAILABLE_TOOLS\]|/?SYSTEM_PROMPT\])"
)
_PLAIN = re.compile(r"([<\[])(\\*)" + _MARK)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _MARK)
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: Sequence[Turn], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and its loss mask: spans of code points that hold the texts of the role ``trained``."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{MIDDLE}", escape(text)
        if role == trained:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), mask


def parse(formatted: str) -> Iterator[Turn]:
    for m in _TURN.finditer(formatted):
        yield unescape(m[1]), unescape(m[2])


# -- DataFrames ---------------------------------------------------------------------------------------------------

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def format_records(df: DataFrame, record: str, trained: str = "assistant") -> DataFrame:
    """``df`` with ``layout``, ``formatted`` and ``loss_mask`` of each record, a JSON text.

    Layout, text and mask are null where the JSON can't be read or no mapping answers to its fingerprint. Rows are
    independent, repeated ones are formatted alike; a very long record is one value and takes one task's time in
    proportion to its length; columns named as the new ones are replaced, the others stay; an empty table gives an
    empty one.
    """

    def one(value: str | None) -> tuple:
        try:
            found = turns_of(json.loads(value)) if value else None
        except ValueError:
            found = None
        if found is None:
            return None, None, None
        formatted, mask = render(found[1], trained)
        return found[0], formatted, [{"start": a, "end": b} for a, b in mask]

    fields = [T.StructField("layout", T.StringType()), T.StructField("formatted", T.StringType()), T.StructField("loss_mask", _SPAN)]
    return with_row_columns(df, record, fields, lambda: lambda values: list(zip(*map(one, values))) or [[], [], []])


def read_back(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """``df`` with ``turns``, array of (role, text), read from the formatted text; a null text gives null, an empty one no
    turns. Rows are independent; a column named ``turns`` is replaced, the others stay; an empty table gives an empty one."""
    turns = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    one = lambda v: None if v is None else [{"role": r, "text": t} for r, t in parse(v)]
    return with_row_columns(df, formatted, [T.StructField("turns", turns)], lambda: lambda values: [[one(v) for v in values]])


def masked_text(df: DataFrame, formatted: str = "formatted", mask: str = "loss_mask", out: str = "loss_text") -> DataFrame:
    """``df`` with the unescaped text that lies under the loss mask, span after span with nothing between; null where there
    is no formatted text, empty where the mask is. A column named ``out`` is replaced, the others stay."""
    both = df.withColumn("__chat_both", F.struct(F.col(formatted).alias("f"), F.col(mask).alias("m")))
    packed = both.withColumn("__chat_both", F.when(F.col(formatted).isNotNull(), F.to_json("__chat_both")))

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        x = json.loads(value)
        return "".join(unescape(x["f"][s["start"] : s["end"]]) for s in x.get("m", []))

    return with_row_columns(packed, "__chat_both", [T.StructField(out, T.StringType())], lambda: lambda values: [[one(v) for v in values]]).drop("__chat_both")


def gathered(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, record): the rows of each conversation as one record, as JSON, in a layout that can hold its turns.

    In order of turn, then role and text, repeated rows included; null turns come first; null roles and texts are empty.
    A conversation is one value in the end, so its rows meet in one task; they are lists from the map side on. A row
    without a conversation id is a conversation by itself, so such rows never meet. Other columns are left out. The
    layouts are dealt out by ids: messages, messages with texts, a dialogue, nested data, and prompt and response where a
    conversation is a question and its answer, perhaps behind a system's turn.
    """
    message = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    found = rows.select(F.col(conv_id).alias("conv_id"), message.alias("m"))
    lists = found.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    lists = lists.unionByName(found.where("conv_id IS NULL").select("conv_id", F.array("m").alias("m")))
    listed = lambda role, text: F.transform("m", lambda m: F.struct(m["role"].alias(role), m["content"].alias(text)))
    json_ = lambda value, name: F.to_json(F.struct(value.alias(name)))
    messages, kind = listed("role", "content"), F.pmod(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)), F.lit(5))
    roles = F.transform("m", lambda m: m["role"])
    asked, led = (roles == F.array(*map(F.lit, names)) for names in (("user", "assistant"), ("system", "user", "assistant")))
    at = lambda i: F.get("m", i)["content"]
    record = (
        F.when(kind == 1, json_(listed("role", "text"), "messages"))
        .when(kind == 2, json_(listed("speaker", "utterance"), "dialogue"))
        .when(kind == 3, json_(F.struct(messages.alias("messages")), "data"))
        .when((kind == 4) & asked, F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
        .when((kind == 4) & led, F.to_json(F.struct(at(0).alias("system"), at(1).alias("prompt"), at(2).alias("response"))))
    )
    return lists.select("conv_id", F.coalesce(record, json_(messages, "messages")).alias("record"))
