"""The text forms as column functions.

Spark has no Unicode normal form and no case folding, so those two are Arrow UDFs that get only the
rows with non-ASCII characters; ASCII rows never leave the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquill.functions import batches

#: The 29 characters of white space of Python's str methods, as a Java character class.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"
#: Unit separator, between the parts of a hashed key.
UNIT = "\x1f"


_nfc = batches.of_one(lambda x: unicodedata.normalize("NFC", x), T.StringType())
_fold = batches.of_one(lambda x: x.casefold(), T.StringType())


def _beyond_ascii(text: Column) -> Column:
    return F.when(F.length(text) != F.octet_length(text), text)


def nfc(text: Column) -> Column:
    """Unicode normal form C; ASCII is in it already."""
    return F.coalesce(_nfc(_beyond_ascii(text)), text)


def casefold(text: Column) -> Column:
    """Full case folding; for ASCII that is lower case."""
    return F.coalesce(_fold(_beyond_ascii(text)), F.lower(text))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Without white space at the ends, and one space for each run inside."""
    return F.regexp_replace(strip(text), f"{SPACE}+", " ")


def payload(text: Column) -> Column:
    """What is emitted: ends stripped, normal form C, inner spaces and case kept."""
    return nfc(strip(text))


def key(payload_text: Column) -> Column:
    """What duplicates and conflicts are found by: a payload with spaces collapsed, case kept."""
    return collapse(payload_text)


_canonical = batches.of_one(lambda x: " ".join(unicodedata.normalize("NFC", x).split()).casefold(), T.StringType())


def canonical(text: Column) -> Column:
    """What leaks are found by: normal form C, spaces collapsed, case folded. One Arrow call does all of it for rows beyond ASCII."""
    return F.coalesce(_canonical(_beyond_ascii(text)), F.lower(collapse(text)))


def dense(text: Column) -> Column:
    """What n-grams are taken of: normal form C without any white space."""
    return F.regexp_replace(nfc(text), f"{SPACE}+", "")


def group_hash(seed: int, source_key: Column) -> Column:
    """SHA-256 of seed and source key: a seeded order that no corpus order changes."""
    return F.sha2(F.concat(F.lit(f"{seed}{UNIT}"), source_key), 256)


def length_ratio(left: Column, right: Column) -> Column:
    """Longer over shorter in code points; an empty side counts as 1."""
    a, b = F.length(left), F.length(right)
    return F.greatest(a, b).cast("double") / F.greatest(F.lit(1), F.least(a, b))


def length_problem(left: Column, right: Column, max_ratio: float, max_chars: int | None = None) -> Column:
    """``ratio`` or ``chars`` for the first bound that a pair exceeds, else null. Ratio 0 bounds nothing."""
    a, b = F.length(left), F.length(right)
    longer, shorter = F.greatest(a, b), F.least(a, b)
    out = F.lit(None).cast("string")
    if max_chars is not None:
        out = F.when(longer > max_chars, "chars")
    if max_ratio > 0:
        out = F.when(longer > F.lit(float(max_ratio)) * F.greatest(F.lit(1), shorter), "ratio").otherwise(out)
    return out
