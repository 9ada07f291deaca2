"""Tokens: the typed, deterministic placeholders of detected values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token looks like, for reversal and for hold-back in streams.
TOKEN = r"\[PII_[A-Z0-9]+_[0-9a-f]{16}\]"


def token(pii_type: str | Column, original: Column) -> Column:
    """`[PII_<TYPE>_<first 16 hex digits of the MD5 of the value>]`."""
    kind = F.upper(pii_type) if isinstance(pii_type, Column) else F.lit(pii_type.upper())
    return F.concat(F.lit("[PII_"), kind, F.lit("_"), F.substring(F.md5(original.cast("binary")), 1, 16), F.lit("]"))


def sql_literal(text: str) -> str:
    """The text as a Spark SQL string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def token_sql(pii_type: str, original: str) -> str:
    """The token of a value, as Spark SQL text."""
    return f"concat({sql_literal(f'[PII_{pii_type.upper()}_')}, substring(md5(CAST({original} AS BINARY)), 1, 16), ']')"


def session_id() -> Column:
    """A random name of a session, 16 hex digits; for rows that have no key of their own."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)


def client_hash(address: Column) -> Column:
    """A linkable name of a client: the first eight hex digits of the SHA-256 of its address."""
    return F.substring(F.sha2(address.cast("binary"), 256), 1, 8)


def longest_token(types: list[str]) -> int:
    """Length of the longest token of these types."""
    return max(len(t) for t in types) + len("[PII_") + len("_") + 16 + len("]")
