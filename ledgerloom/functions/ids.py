"""Identifier columns that compare as values, not as spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 17 bytes, so that a key made from any other text can never have a UUID's 16 bytes
_OTHER = "\x01not-a-uuid-text"


def uuid_key(c: Column) -> Column:
    """A binary key: the 16 bytes of a UUID however it is written (case, braces, hyphens,
    ``urn:uuid:``, outer blanks), else the trimmed text behind a 17-byte mark.
    Null and blank give null."""
    plain = F.replace(F.translate(F.lower(c), "-{} \t\r\n", ""), F.lit("urn:uuid:"), F.lit(""))
    text = F.trim(c)
    return F.when(plain.rlike("^[0-9a-f]{32}$"), F.unhex(plain)).when(
        F.length(text) > 0, F.encode(F.concat(F.lit(_OTHER), text), "UTF-8")
    )


def uuid_text(key: Column) -> Column:
    """The lower-case 8-4-4-4-12 text of a key (or the text it was made from)."""
    h = F.lower(F.hex(key))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.length(key) == 16, F.concat_ws("-", *parts)).otherwise(
        F.substring(F.decode(key, "UTF-8"), len(_OTHER) + 1, 1 << 30)
    )
