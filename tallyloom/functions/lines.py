"""One grammar for the lines of a marked transcript, linear in the text: each line is looked at once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: a chapter's line, an image's line, a stamp at the beginning of a line, and the stamp of an answer
CHAPTER = r"^## \[\d{2}:\d{2}:\d{2}\]"
IMAGE = r"^!\[Snapshot at"
STAMPED = r"^(?:## )?\[(\d{2}):(\d{2}):(\d{2})\]"
STAMP = r"^(\d{2}):(\d{2}):(\d{2})"


def seconds(text: Column, pattern: str = STAMP) -> Column:
    """Seconds of the stamp that a text begins with, or null."""
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("long")
    return part(1) * 3600 + part(2) * 60 + part(3)


def typed_lines(text: Column) -> Column:
    """Array of at (from 0), kind (chapter, image, stamped or plain), seconds (of the line's stamp, or null), body (what follows the stamp)
    and line; a null text gives null, an empty one its one empty line."""

    def one(line: Column, at: Column) -> Column:
        kind = F.when(line.rlike(CHAPTER), "chapter").when(line.rlike(IMAGE), "image").when(line.rlike(STAMPED), "stamped").otherwise("plain")
        body = F.regexp_replace(line, rf"{STAMPED}\s*", "")
        return F.struct(at.cast("int").alias("at"), kind.alias("kind"), seconds(line, STAMPED).alias("seconds"), body.alias("body"), line.alias("line"))

    return F.transform(F.split(text, "\n"), one)
