"""Text functions: Column in, Column out, all inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that Python's str.strip() removes (29 of them).
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Results depend on these exact strings.
DEFAULT_MARKER = "-éveré"
DEFAULT_STOPS = ("<|eot_id|>", "\n<|start_header_id|>", "<|end_header_id|>")


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends; ``trim`` would remove blanks only."""
    return F.btrim(text, F.lit(PY_WHITESPACE))


def has_marker(text: Column, marker: str = DEFAULT_MARKER) -> Column:
    return F.contains(text, F.lit(marker))


def cut_at_marker(text: Column, marker: str = DEFAULT_MARKER) -> Column:
    """Text before the first marker, or all of it when there is none."""
    return F.substring_index(text, marker, 1)


def clean_response(text: Column, marker: str = DEFAULT_MARKER) -> Column:
    return strip(cut_at_marker(text, marker))


def normalize_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF, as when a file is opened in text mode."""
    return F.regexp_replace(text, "\r\n?", "\n")


def clean_document(text: Column) -> Column:
    return strip(normalize_newlines(text))


def cut_at_stop(text: Column, stops: Sequence[str] = DEFAULT_STOPS) -> Column:
    """Text before the earliest of several literal stop sequences.

    Compares positions, so stops that overlap one another are also right.
    """
    found = [F.when(F.instr(text, s) > 0, F.instr(text, s)) for s in stops]
    first = found[0] if len(found) == 1 else F.least(*found)
    return F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1))


def fixed4(x: Column) -> Column:
    """``x`` with four decimals, rounded exactly as Python's ``f"{x:.4f}"``.

    ``format_string('%.4f')`` rounds ties up and looks at the shortest decimal
    form instead of the binary value. Here the double is split in two halves so
    that ``x * 20000`` compared with an odd integer is free of rounding error.
    """
    a = F.abs(x)
    low = F.floor(a * 10000)
    high_half = a.cast("float").cast("double")
    low_half = a - high_half
    side = (high_half * 20000 - (low * 2 + 1)) + low_half * 20000
    up = (side > 0) | ((side == 0) & (F.pmod(low, F.lit(2)) == 1))
    n = low + F.when(up, 1).otherwise(0)
    digits = F.concat(
        F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise(""),
        F.floor(n / 10000).cast("string"),
        F.lit("."),
        F.lpad(F.pmod(n, F.lit(10000)).cast("string"), 4, "0"),
    )
    return (
        F.when(F.isnan(x), "nan")
        .when(a == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when(a < 1e9, digits)
        .otherwise(F.format_string("%.4f", x))
    )

