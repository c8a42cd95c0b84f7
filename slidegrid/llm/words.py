"""Words, ASCII lower case and hold-out rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Java form of the separators in ``[^\x20\x09-\x0D]+``.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole_text(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\x20\x09-\x0D]+`` of a text that is not null."""
    return F.array_remove(F.split(text, BLANKS), "")


def word_count(text: Column) -> Column:
    """How many such words, without building them: places where a word begins."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def remainder(key: str | Column, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``; null for a null key."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string")) % by


def is_held_out(key: str | Column, by: int, at: int) -> Column:
    """Whether the key's remainder is ``at``; a null key is not held out."""
    return F.coalesce(remainder(key, by) == at, F.lit(False))


def let(value: Column, body) -> Column:
    """``body`` of a value that it uses several times: bound once, as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
