"""Text scalars as built-in Column expressions (stay inside whole-stage codegen).

Python's ``str.strip`` / ``str.split`` treat every Unicode white space as a separator while
Spark's ``trim`` removes only the space character, so white space is matched with the
Unicode-aware Java class ``(?U)\\s`` here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions._util import as_col

_WS_EDGES = r"(?U)^\s+|\s+$"
_WORD = r"(?U)\S+"


def strip_ws(c) -> Column:
    """Remove leading and trailing white space (Unicode aware, like ``str.strip()``)."""
    return F.regexp_replace(as_col(c), _WS_EDGES, "")


def strip_label(c, label: str) -> Column:
    """Remove every occurrence of ``label`` (e.g. ``Response 1:``), then strip white space."""
    return strip_ws(F.replace(as_col(c), F.lit(label), F.lit("")))


def word_count(c) -> Column:
    """Number of white-space separated words (``len(s.split())``); NULL stays NULL."""
    return F.regexp_count(as_col(c), F.lit(_WORD)).cast("long")


def words(c) -> Column:
    """The words of a text as an array (``s.split()``)."""
    return F.regexp_extract_all(as_col(c), F.lit(_WORD), 0)


def parse_preference(c) -> Column:
    r"""X4 + F3: keep the decimal digits of the answer; exactly '0' or '1' becomes 0/1, else NULL.

    ``"Response 1 ... 0"`` keeps ``"10"`` and therefore yields NULL, as does an empty answer.
    Python's ``str.isdigit`` also accepts digit-like signs such as superscripts ('²0' -> NULL), so
    other numbers (``\p{No}``) are kept too; unlike Python, vulgar fractions are kept as well.
    """
    digits = F.regexp_replace(as_col(c), r"[^\p{Nd}\p{No}]", "")
    return F.when(digits.isin("0", "1"), digits.cast("int")).otherwise(F.lit(None).cast("int"))


def path_name(c) -> Column:
    """A model or dataset name as a single path component (``/`` -> ``_``)."""
    return F.replace(as_col(c), F.lit("/"), F.lit("_"))


def reward_input(prompt, output) -> Column:
    """Text handed to the reward model, prompt immediately followed by the output."""
    return F.concat(as_col(prompt), as_col(output))


def fmt4(c) -> Column:
    """Four decimals as text; NULL stays NULL (bare ``format_string`` would give 'null')."""
    x = as_col(c)
    return F.when(x.isNotNull(), F.format_string("%.4f", x))


def ceil_div(n, k) -> Column:
    """Ceiling division of two integers, as long."""
    n, k = as_col(n), as_col(k)
    return F.when(k > 0, F.floor((n + k - F.lit(1)) / k)).cast("long")


def take_count(ratio: float, n) -> Column:
    """``int(ratio * n)`` - the number of rows a share selects (double arithmetic)."""
    return F.floor(F.lit(float(ratio)).cast("double") * as_col(n).cast("double")).cast("long")


def hash_hex(seed, *keys) -> Column:
    """md5 over ``seed:key1:key2...``; deterministic and independent of partitioning."""
    parts = [F.lit(str(seed))] + [as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_unit32(hex_col) -> Column:
    """The first 32 bits of a hex digest as a non-negative long (0 .. 2^32-1)."""
    return F.conv(F.substring(as_col(hex_col), 1, 8), 16, 10).cast("long")
