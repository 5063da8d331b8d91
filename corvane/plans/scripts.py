"""SQL scripts, statement by statement."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Strings, quoted names and comments are passed over whole; a semicolon outside of them ends a statement.
_TOKENS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'\"`;/-]+|[/-]", re.S)


def statements(script: str) -> Iterator[str]:
    """The statements of a script, without comments and empty ones."""
    own: list[str] = []
    for token in [*_TOKENS.findall(script), ";"]:
        if token == ";":
            if statement := "".join(own).strip():
                yield statement
            own = []
        elif not token.startswith(("--", "/*")):
            own.append(token)


def run_script(spark: SparkSession, script: str, **args: object) -> DataFrame | None:
    """Runs all statements with the named parameters; returns what the last one gives."""
    out = None
    for statement in statements(script):
        out = spark.sql(statement, args={k: v for k, v in args.items() if f":{k}" in statement})
    return out
