"""Text normalisation and contact fields as column expressions.

White space means ECMAScript's: Java's ``\\s`` and Spark's ``trim`` know less. Patterns end in ``\\z`` since Java's ``$``
also matches before a last line feed. Everything is JVM-side but for compatibility normalisation, which Spark lacks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of ECMAScript.
JS_WS_CHARS = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
JS_WS = r"[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: What an address consists of.
_LOCAL, _DOMAIN = r"[a-z0-9.!#$%&'*+/=?^_`{|}~-]+", r"[a-z0-9-]+(?:\.[a-z0-9-]+)+"
#: Domains and local parts of placeholder, test and machine addresses.
PLACEHOLDER_DOMAINS = ("example.com", "example.org", "example.net", "test.com", "localhost.local")
_TEST_LOCAL, _MACHINE_LOCAL = r"(?i)^(test|demo|sample|fake|invalid)([+._-]|\z)", r"(?i)^(no-?reply|donotreply)\z"
#: Texts of these characters only are their own compatibility form.
_STABLE = r"^[ -~Ѐ-џ\xab\xbb]*\z"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it: expressions are trees, and one that
    is named many times in several steps would grow beyond what can be compiled."""
    return F.get(F.transform(F.array(value), body), 0)


def is_stable(text: Column) -> Column:
    """Is the text certain to be its own compatibility form?"""
    return text.rlike(_STABLE)


def nfkc(text: Column) -> Column:
    """Unicode compatibility form. Texts that are certain to be their own form don't travel to Python."""
    return F.coalesce(_nfkc(F.when(~text.rlike(_STABLE), text)), text)


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{JS_WS}+", " "))


def clean_text(text: Column, unicode: bool = True) -> Column:
    """Compatibility form, collapsed; null if nothing is left. ``unicode=False``: for texts known to be in that form."""
    return F.nullif(collapse(nfkc(text) if unicode else text), F.lit(""))


def normalize_text(text: Column, unicode: bool = True) -> Column:
    """Cleaned, lower case, one letter for both kinds of Cyrillic e; never null."""
    return F.translate(F.lower(F.coalesce(clean_text(text, unicode), F.lit(""))), "ё", "е")


def identity_text(text: Column, unicode: bool = True) -> Column:
    """Normalised, with only letters and digits and single spaces between."""
    return F.trim(F.regexp_replace(normalize_text(text, unicode), r"[^\p{L}\p{N}]+", " "))


def normalize_key(key: Column, unicode: bool = True) -> Column:
    """A field name without case, punctuation and spaces."""
    return F.regexp_replace(F.lower(nfkc(key) if unicode else key), r"[^\p{L}\p{N}]", "")


def normalize_email(text: Column, unicode: bool = True) -> Column:
    """The first address in a text, in lower case; null without one. What stands around it is ignored."""
    bare = F.regexp_replace(clean_text(text, unicode), "(?i)^mailto:", "")
    found = lambda t: F.lower(F.nullif(F.regexp_extract(t, f"(?i){_LOCAL}@{_DOMAIN}", 0), F.lit("")))
    return let(bare, lambda t: F.when(t.contains("@"), found(t)))  # the pattern is tried at every place of a text


def is_plausible_email(email: Column) -> Column:
    return let(email, _is_plausible)


def _is_plausible(email: Column) -> Column:
    local, domain = F.substring_index(email, "@", 1), F.substring_index(email, "@", -1)
    shape = email.rlike(f"(?i)^{_LOCAL}@{_DOMAIN}\\z") & (F.length(email) <= 254) & ~email.rlike(rf"{JS_WS}|[Ѐ-ӿ]")
    dots = local.startswith(".") | local.endswith(".") | local.contains("..")
    hyphens = F.exists(F.split(domain, r"\."), lambda label: label.startswith("-") | label.endswith("-"))
    return F.coalesce(shape & ~dots & ~hyphens, F.lit(False))


def is_suspicious_email(email: Column) -> Column:
    """Placeholder domains, and local parts of tests and machines."""
    parts = F.split(email, "@")
    local, domain = F.coalesce(F.get(parts, 0), F.lit("")), F.coalesce(F.get(parts, 1), F.lit(""))
    found = domain.isin(*PLACEHOLDER_DOMAINS) | local.rlike(_TEST_LOCAL) | local.rlike(_MACHINE_LOCAL)
    return F.coalesce((email != "") & found, F.lit(False))


def normalize_phone(text: Column, unicode: bool = True) -> Column:
    """``+`` and digits: eleven that start with 8 or 7 are Russian, others have 7 to 15; null for anything else."""
    cleaned = clean_text(text, unicode)
    digits = F.when(cleaned.rlike(rf"^(?:[0-9+()\-.]|{JS_WS})*\z"), F.regexp_replace(cleaned, "[^0-9]", ""))
    return let(digits, _international)


def _international(digits: Column) -> Column:
    size = F.length(digits)
    national = F.when((size == 11) & digits.startswith("8"), F.concat(F.lit("7"), F.substring(digits, 2, 10))).when((size == 11) & digits.startswith("7"), digits)
    foreign = F.when(~digits.startswith("7") & size.between(7, 15), digits)
    return F.concat(F.lit("+"), F.coalesce(national, foreign))


def dedupe_key(external_id: Column, name: Column, city: Column, address: Column, email: Column, phone: Column, website: Column, unicode: bool = True) -> Column:
    """SHA-256 of the strongest identity a record has: id, then e-mail, phone or site with the name, then name and place.

    ``name``, ``city`` and contacts are normalised already. Tiers don't meet: a record with an id never equals one without.
    """
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), c, F.lit("|name:"), name)
    place = F.concat(F.lit("name:"), name, F.lit("|city:"), F.coalesce(city, F.lit("")), F.lit("|address:"), normalize_text(address, unicode))
    identity = F.when(filled(external_id), F.concat(F.lit("external:"), normalize_text(external_id, unicode))).when(filled(email), named("email", email))
    return F.sha2(identity.when(filled(phone), named("phone", phone)).when(filled(website), named("website", website)).otherwise(place), 256)


def looks_like_mojibake(text: Column) -> Column:
    """Cyrillic pairs that UTF-8 read as a single-byte code page leaves."""
    return text.rlike("(?:Р.|С.){3,}|Рњ|РЎ|Рµ|Р°|Рє")
