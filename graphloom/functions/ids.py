"""Identifiers derived from names and contents: the first 32 hex digits of a SHA-256 over joined parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _digest(*parts: Column) -> Column:
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.unhex(F.lit("00")), part)
    return F.substring(F.sha2(joined, 256), 1, 32)


def _text(column: Column) -> Column:
    return F.encode(column, "UTF-8")


def project_id(path: Column) -> Column:
    return _digest(_text(path))


def file_id(project: Column, path: Column) -> Column:
    return _digest(F.unhex(project), _text(path))


def symbol_id(project: Column, path: Column, qualified_name: Column, kind: Column) -> Column:
    return _digest(F.unhex(project), _text(path), _text(qualified_name), F.unhex(F.lpad(F.hex(kind.cast("long")), 2, "0")))


def symbol_version_id(identity: Column, content_hash: Column) -> Column:
    return _digest(F.unhex(identity), F.unhex(content_hash))


def content_hash(text: Column) -> Column:
    return F.sha2(_text(text), 256)


def short_id(identity: Column) -> Column:
    """For display only."""
    return F.substring(identity, 1, 8)


def is_id(identity: Column) -> Column:
    return F.coalesce(identity.rlike("^[0-9a-f]{32}$"), F.lit(False))


def snapshot_uuid(nanoseconds: Column, sequence: Column) -> Column:
    """Time and sequence number in hex, 32 and 16 digits."""
    return F.concat(F.lpad(F.lower(F.hex(nanoseconds.cast("long"))), 32, "0"), F.lpad(F.lower(F.hex(sequence.cast("long"))), 16, "0"))


def checked(identity: Column) -> Column:
    """The id itself; an error where it is not 16 bytes in hex."""
    return F.when(is_id(identity), identity).otherwise(F.raise_error(F.concat(F.lit("not a 16-byte id: "), F.coalesce(identity, F.lit("null")))).cast("string"))
