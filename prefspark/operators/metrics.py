"""Single-pass aggregates: word totals, profile, cost estimate, pairwise reward and DPO metrics.

Each is ONE aggregation (partial aggregation per task, then a final merge of one row per task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions._util import as_col
from prefspark.functions.text import word_count

# FIXED VALUES - the reference's cost model.
TOKENS_PER_WORD = 100.0 / 75.0  # tokens = words * 100 / 75
INPUT_PRICE_PER_M = 0.15        # $ per 1M input tokens
OUTPUT_PRICE_PER_M = 0.6        # $ per 1M output tokens
REWARD_CENTER_COEF = 0.1        # centring coefficient of the pairwise reward loss
DPO_BETA = 0.1


def row_words(*cols) -> Column:
    """Words of several text columns together (A1 per row)."""
    total = None
    for c in cols:
        w = F.coalesce(word_count(c), F.lit(0))
        total = w if total is None else total + w
    return total


def total_words(df: DataFrame, cols: Sequence[str] = ("prompt", "response_1", "response_2"),
                by: Sequence[str] = ()) -> DataFrame:
    """A1: sum of the word counts of ``cols`` (per group ``by``)."""
    agg = F.sum(row_words(*cols)).cast("long").alias("total_words")
    return df.groupBy(*by).agg(agg, F.count(F.lit(1)).alias("n_rows"))


def row_count(df: DataFrame) -> DataFrame:
    """A3."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A4 (``df.info()``): per column its type and non-null count, plus the row count.

    One aggregation computes every ``count(col)``; ``stack`` turns the single wide row into
    (column_name, dtype, non_null) rows.
    """
    cols = [f for f in df.schema.fields if f.name not in by]
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [F.count(F.col(f.name)).alias(f"_nn{i}") for i, f in enumerate(cols)]
    wide = df.groupBy(*by).agg(*aggs)
    stack_args = ", ".join(f"'{f.name}', '{f.dataType.simpleString()}', _nn{i}" for i, f in enumerate(cols))
    long = wide.select(*by, "n_rows",
                       F.expr(f"stack({len(cols)}, {stack_args}) AS (column_name, dtype, non_null)"))
    return long.select(*by, "column_name", "dtype", F.col("non_null").cast("long").alias("non_null"), "n_rows")


def cost_report(df: DataFrame, input_cols: Sequence[str], output_cols: Sequence[str],
                in_price: float = INPUT_PRICE_PER_M, out_price: float = OUTPUT_PRICE_PER_M,
                by: Sequence[str] = (), output_factor: float = 1.0, runs: int = 1) -> DataFrame:
    """Token estimate (words * 100/75) and cost (tokens * price / 1e6) of inputs and outputs, and
    their totals: ``weighted_tokens`` = input + output * ``output_factor``, ``run_tokens`` and ``run_cost`` =
    ``runs`` times the sum of both."""
    in_words = F.sum(row_words(*input_cols)).cast("long")
    out_words = F.sum(row_words(*output_cols)).cast("long")
    agg = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), in_words.alias("input_words"),
                               out_words.alias("output_words"))
    tpw = F.lit(TOKENS_PER_WORD).cast("double")
    return (agg.withColumn("input_tokens", F.col("input_words").cast("double") * tpw)
               .withColumn("output_tokens", F.col("output_words").cast("double") * tpw)
               .withColumn("input_cost", F.col("input_tokens") * F.lit(float(in_price)) / F.lit(1e6))
               .withColumn("output_cost", F.col("output_tokens") * F.lit(float(out_price)) / F.lit(1e6))
               .withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))
               .withColumn("weighted_tokens", F.col("input_tokens") + F.col("output_tokens") * F.lit(float(output_factor)))
               .withColumn("run_tokens", (F.col("input_tokens") + F.col("output_tokens")) * F.lit(float(runs)))
               .withColumn("run_cost", F.col("total_cost") * F.lit(float(runs))))


def neg_log_sigmoid(d: Column) -> Column:
    """-log(sigmoid(d)), numerically stable: max(-d, 0) + log1p(exp(-|d|))."""
    return F.greatest(-d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))


def reward_eval_metrics(df: DataFrame, chosen="r_chosen", rejected="r_rejected",
                        center: float = REWARD_CENTER_COEF, ties: str = "wrong") -> DataFrame:
    """Pairwise reward-model metrics in one pass.

    accuracy = share of pairs with r_c > r_r; margin = mean(r_c - r_r);
    loss = mean(-log sigmoid(r_c - r_r)) + center * mean((r_c + r_r)^2).
    ``ties`` (r_c == r_r): "wrong" counts them as misses (default), "correct" as hits (an argmax
    over [r_c, r_r] picks the first), "exclude" leaves them out of the accuracy.
    """
    rc, rr = as_col(chosen).cast("double"), as_col(rejected).cast("double")
    d = rc - rr
    if ties == "wrong":
        hit = F.when(d > 0, 1.0).otherwise(0.0)
    elif ties == "correct":
        hit = F.when(d >= 0, 1.0).otherwise(0.0)
    elif ties == "exclude":
        hit = F.when(d > 0, 1.0).when(d < 0, 0.0)  # NULL for ties: avg ignores them
    else:
        raise ValueError("ties must be 'wrong', 'correct' or 'exclude'")
    return df.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg(hit).alias("accuracy"),
        F.avg(d).alias("mean_margin"),
        (F.avg(neg_log_sigmoid(d)) + F.lit(float(center)) * F.avg((rc + rr) * (rc + rr))).alias("loss"),
    )


def dpo_eval_metrics(df: DataFrame, beta: float = DPO_BETA, pi_chosen="pi_chosen", pi_rejected="pi_rejected",
                     ref_chosen="ref_chosen", ref_rejected="ref_rejected") -> DataFrame:
    """DPO metrics from policy and reference log-probabilities (sigmoid loss)."""
    b = F.lit(float(beta))
    cr = b * (as_col(pi_chosen) - as_col(ref_chosen))
    rr = b * (as_col(pi_rejected) - as_col(ref_rejected))
    return df.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg(cr).alias("rewards_chosen"),
        F.avg(rr).alias("rewards_rejected"),
        F.avg(F.when(cr > rr, 1.0).otherwise(0.0)).alias("rewards_accuracy"),
        F.avg(cr - rr).alias("rewards_margin"),
        F.avg(neg_log_sigmoid(cr - rr)).alias("loss"),
    )
