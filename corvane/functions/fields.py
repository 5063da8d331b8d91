"""Fields of records whose shape is not known: flattened keys, aliases, scalars."""

from __future__ import annotations

import json
import re
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import JS_WS_CHARS

#: The names that a field goes by, without case, spaces and punctuation.
ALIASES = {
    "external_id": ("id", "uuid", "companyid", "organizationid", "externalid", "идентификатор"),
    "name": ("name", "title", "company", "companyname", "organization", "organizationname", "название", "наименование", "компания"),
    "category": ("category", "categoryname", "rubric", "rubrics", "industry", "type", "категория", "рубрика", "отрасль"),
    "city": ("city", "town", "locality", "settlement", "locationcity", "город", "населенныйпункт", "населённыйпункт"),
    "address": ("address", "fulladdress", "formattedaddress", "streetaddress", "адрес"),
    "rating": ("rating", "rate", "score", "stars", "averagerating", "рейтинг", "оценка"),
    "reviews_count": ("reviewscount", "reviewcount", "reviews", "reviewsnumber", "ratingcount", "числоотзывов", "количествоотзывов", "отзывов"),
    "website": ("website", "site", "url", "web", "homepage", "сайт"),
    "email": ("email", "mail", "emails", "contactemail", "почта", "электроннаяпочта"),
    "phone": ("phone", "telephone", "tel", "phonenumber", "phones", "contactphone", "телефон"),
}
#: All names of all fields.
RECOGNIZED = frozenset(a for names in ALIASES.values() for a in names)
#: Where an object's text is looked for, in this order.
TEXT_KEYS = ("name", "title", "label", "value", "text", "email", "phone", "url")
DEPTH = 5
_SPACES = re.compile(f"[{re.escape(JS_WS_CHARS)}]+")


def plain_key(key: str) -> str:
    """A key without case, spaces and punctuation."""
    return "".join(c for c in unicodedata.normalize("NFKC", key).lower() if unicodedata.category(c)[0] in "LN")


def cleaned(text: str) -> str | None:
    return _SPACES.sub(" ", unicodedata.normalize("NFKC", text)).strip(" ") or None


def flatten(record: dict) -> dict[str, object]:
    """Plain keys in document order, outer before inner ones; the first of equal keys holds. Lists are values."""
    out: dict[str, object] = {}

    def visit(inner: dict, depth: int) -> None:
        for key, value in inner.items():
            out.setdefault(plain_key(key), value)
            if isinstance(value, dict) and depth < DEPTH:
                visit(value, depth + 1)

    visit(record, 0)
    return out


def pick(flat: dict[str, object], field: str):
    """The value of the first key, in document order, that the field goes by, even if it is null."""
    return next((v for k, v in flat.items() if k in ALIASES[field]), None)


def likeness(record: dict) -> int:
    """How much a record looks like a company: 4 for a name, 1 for each of six other fields."""
    flat = flatten(record)
    return sum(4 if f == "name" else 1 for f in ("name", "city", "category", "address", "website", "phone", "email") if pick(flat, f) is not None)


def scalar(value) -> str | None:
    """A value as cleaned text: numbers as ECMAScript prints them, lists joined by commas, objects by a telling key."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return cleaned(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return _as_ecmascript(value)
    if isinstance(value, list):
        return ", ".join(x for v in value if (x := scalar(v))) or None
    if isinstance(value, dict):
        return next((x for k in TEXT_KEYS if (x := scalar(value.get(k)))), None)
    return None


def _as_ecmascript(value: float) -> str:
    """The shortest digits that give the number back, with an exponent from 1e21 on and below 1e-6."""
    if value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    if 1e-6 <= abs(value) < 1e-4:  # Python has an exponent here already
        return format(Decimal(repr(value)), "f")
    return re.sub(r"e([+-])0+", r"e\1", repr(value))


#: The picked fields as text; ``reviews_listed`` is the size of a list of reviews.
FIELDS = (*ALIASES, "reviews_listed")


def pick_all(record: str | None) -> list:
    flat = flatten(found) if record is not None and isinstance(found := json.loads(record), dict) else {}
    picked = {f: pick(flat, f) for f in ALIASES}
    listed = picked["reviews_count"]
    return [*(scalar(v) for v in picked.values()), str(len(listed)) if isinstance(listed, list) else None]


@F.pandas_udf(T.StructType([T.StructField(f, T.StringType()) for f in FIELDS]))
def extract_fields(records: pd.Series) -> pd.DataFrame:
    """The ten fields of JSON records, cleaned."""
    return pd.DataFrame([pick_all(r) for r in records], columns=list(FIELDS))
