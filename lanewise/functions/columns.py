"""Column factories: text and value parsing, tokens, delays, ratios. All run inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ssX"

# Words read as true and as false.
TRUE_WORDS = ("true", "t", "1", "yes", "y")
FALSE_WORDS = ("false", "f", "0", "no", "n")

# Canonical status of each known status word.
STATUS_WORDS = {
    "PICKED_UP": ("PICKUP", "PICKEDUP", "PICKED_UP"),
    "IN_TRANSIT": ("INTRANSIT", "IN_TRANSIT", "TRANSIT"),
    "OUT_FOR_DELIVERY": ("OUTFORDELIVERY", "OUT_FOR_DELIVERY"),
    "DELIVERY_ATTEMPT": ("DELIVERYATTEMPT", "DELIVERY_ATTEMPT", "ATTEMPTED"),
    "DELIVERED": ("DELIVERED", "COMPLETE", "COMPLETED"),
    "DELAYED": ("DELAY", "DELAYED", "LATE"),
    "EXCEPTION": ("EXCEPTION", "FAILED", "ERROR"),
    "HOLD": ("HOLD", "ONHOLD", "ON_HOLD"),
    "CANCELLED": ("CANCELLED", "CANCELED"),
}

# Canonical region of each known region word.
REGION_WORDS = {
    "WEST": ("WEST", "WESTERN"),
    "SOUTH": ("SOUTH", "SOUTHERN"),
    "MIDWEST": ("MIDWEST", "MID_WEST", "CENTRAL"),
    "NORTHEAST": ("NORTHEAST", "NORTH_EAST", "NE"),
}


def filled(text: Column) -> Column:
    """The text without spaces around it; null if nothing is left."""
    bare = F.trim(text.cast("string"))
    return F.when(bare != "", bare)


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value.cast("string")) == "")


def parsed_boolean(text: Column) -> Column:
    word = F.lower(text)
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def parsed_integer(text: Column, kind: str = "int") -> Column:
    """Whole numbers; a decimal tail is cut off, as a lenient cast would, and anything else is null."""
    cut = F.when(text.rlike(r"^\s*[+-]?\d+\.\d*\s*$"), text.try_cast("double").try_cast(kind))
    return F.coalesce(text.try_cast(kind), cut)


def parsed_timestamp(text: Column, formats: Sequence[str] = (DEFAULT_TIMESTAMP_FORMAT,)) -> Column:
    """The first format that fits, else whatever a plain cast reads, else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats), text.try_cast("timestamp"))


def parsed(text: Column, kind: str, formats: Sequence[str] = (DEFAULT_TIMESTAMP_FORMAT,)) -> Column:
    """``text`` as a contract type (string, double, int, bigint, boolean, timestamp); null if it can't be read."""
    if kind == "string":
        return text
    if kind in ("int", "bigint"):
        return parsed_integer(text, kind)
    if kind == "boolean":
        return parsed_boolean(text)
    if kind == "timestamp":
        return parsed_timestamp(text, formats)
    return text.try_cast(kind)


def lookup(words: dict[str, tuple[str, ...]], token: Column) -> Column:
    """The key under which ``token`` is listed; a token that is not listed stays."""
    table = F.create_map(*(F.lit(x) for key, listed in words.items() for word in listed for x in (word, key)))
    return F.coalesce(table[token], token)


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CONTROLS = "".join(map(chr, (*range(0x20), 0x7F)))
_SPACES = "\t\n\x0b\f\r"


def token(text: Column) -> Column:
    """Upper case, with everything but letters and digits as single underscores. Clean texts, most of them, meet no pattern."""
    upper = F.upper(F.trim(text.cast("string")))
    clean = F.translate(upper, _LETTERS + "0123456789", "") == ""
    return F.when(clean, upper).otherwise(F.regexp_replace(upper, "[^A-Z0-9]+", "_"))


def _single_spaces(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " +", " ")).otherwise(text)


def region_code(text: Column) -> Column:
    return lookup(REGION_WORDS, token(text))


def status_code(text: Column) -> Column:
    return lookup(STATUS_WORDS, token(text))


def state_code(text: Column) -> Column:
    """Two letters, or null."""
    upper = F.upper(F.trim(text))
    letters = F.regexp_replace(upper, "[^A-Z]", "")
    two = (F.length(upper) == 2) & (F.translate(upper, _LETTERS, "") == "")
    return F.when(two, upper).when(F.length(letters) == 2, letters)


def clean_text(text: Column) -> Column:
    """Control characters and runs of white space as one space, no spaces around, blank as null."""
    return filled(_single_spaces(F.translate(text, _CONTROLS, " " * len(_CONTROLS))))


def carrier_name(text: Column) -> Column:
    return filled(_single_spaces(F.translate(F.trim(text), _SPACES, " " * len(_SPACES))))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds; null if either is."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def delay_minutes(actual: Column, promised: Column) -> Column:
    """Minutes late, 0 if early; null if either is."""
    late = seconds_between(promised, actual) / F.lit(60.0)
    return F.when(actual.isNotNull() & promised.isNotNull(), F.greatest(late, F.lit(0.0)))


def transit_hours(picked_up: Column, actual: Column) -> Column:
    return seconds_between(picked_up, actual) / F.lit(3600.0)


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or null."""
    return F.when(condition, 1).otherwise(0)


def ratio(part: Column, whole: Column) -> Column:
    """0.0 where the whole is not above 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
