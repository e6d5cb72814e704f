"""Canonical JSON and hashes: sorted keys, NFC, integers only, no blanks."""

from __future__ import annotations

import hashlib
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clean(v):
    if isinstance(v, str):
        return v if v.isascii() else unicodedata.normalize("NFC", v)
    if isinstance(v, bool) or v is None or isinstance(v, int):
        return v
    if isinstance(v, float):
        raise TypeError("only integers are canonical")
    if isinstance(v, dict):
        out = {_clean(k): _clean(x) for k, x in v.items()}
        if len(out) != len(v):
            raise TypeError("keys collide once normalised")
        return out
    return [_clean(x) for x in v]


def canonical(v) -> str:
    return json.dumps(_clean(v), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def digest(text: str | bytes) -> str:
    return "sha256:" + hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def digest_column(c: Column) -> Column:
    """``sha256:<hex>`` of a binary or string column."""
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def short_hash(c: Column) -> Column:
    """The first 12 hex digits of a ``sha256:`` hash."""
    return F.substring(c, 8, 12)


def ppm(part: Column, whole: Column) -> Column:
    """Integer parts per million, rounded down; 0 of nothing."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", part.cast("long") * 1000000, F.nullif(whole.cast("long"), F.lit(0).cast("long"))))
