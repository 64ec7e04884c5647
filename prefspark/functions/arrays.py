"""Token / logit array expressions (X10, X11, X13) with higher-order functions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions._util import as_col


def _mean(arr: Column) -> Column:
    total = F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))
    return F.try_divide(total, F.size(arr).cast("double"))


def mean_logit(logits) -> Column:
    """Scalar reward from a (tokens x vocab) logit matrix - mean over vocab, then over tokens."""
    return _mean(F.transform(as_col(logits), _mean))


def truncate_right(a, n: int) -> Column:
    """X11: keep the first ``n`` elements."""
    return F.slice(as_col(a), 1, n)


def truncate_left(a, n: int) -> Column:
    """X11: keep the last ``n`` elements (``slice(a, -n, n)`` would give [] on short arrays)."""
    arr = as_col(a)
    return F.slice(arr, F.greatest(F.size(arr) - F.lit(n) + F.lit(1), F.lit(1)), F.lit(n))


def pad_left(a, n, pad) -> Column:
    """X11: left-pad with ``pad`` up to length ``n`` (longer arrays are kept as they are)."""
    arr = as_col(a)
    pad_col = as_col(pad) if isinstance(pad, (str, Column)) else F.lit(pad)
    n_col = as_col(n) if isinstance(n, (str, Column)) else F.lit(n)
    missing = F.greatest(n_col - F.size(arr), F.lit(0))
    return F.concat(F.array_repeat(pad_col.cast("int"), missing), arr)


def pad_token(pad_id, eos_id) -> Column:
    """X11: the pad token falls back to the end-of-sequence token when none is set."""
    return F.coalesce(as_col(pad_id) if isinstance(pad_id, (str, Column)) else F.lit(pad_id),
                      as_col(eos_id) if isinstance(eos_id, (str, Column)) else F.lit(eos_id))


def eos_penalty(reward, ids, eos_id: int, penalty: float = 1.0) -> Column:
    """Subtract ``penalty`` from the reward of a completion that lacks the EOS token."""
    r = as_col(reward)
    return F.when(~F.array_contains(as_col(ids), F.lit(eos_id)), r - F.lit(float(penalty))).otherwise(r)
