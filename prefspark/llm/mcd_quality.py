"""Quality rules and robust multivariate outliers.

Base rules fail a text with fewer than ``MIN_WORDS`` words or with more than half of its words in
repeated 3-word windows. Every other text has a vector of transformed statistics; texts far from
the bulk of their language and source are rejected.

The bulk is a minimum-covariance-determinant estimate (location and scatter of the ``KEEP`` share
of rows whose scatter has the least determinant), regularised by what is known of the statistics:
they are square roots of counted shares and the log of a mean, so that the variance that counting alone
gives them follows from the number of words and lines. No scatter is taken smaller than that, and none
narrower, in any direction, than the scatter pooled over the groups of its level. No spread is set by hand.

Each group has two starts (medians and median absolute deviations, taken from histograms; mean and
covariance of all rows). Concentration steps keep the rows nearest in Mahalanobis distance and estimate
again, for each group and start until its determinant stops falling; of all estimates
of a group the one with the least determinant counts. Each step is two aggregations over the narrow table of
all statistics: a histogram of distances per group gives the cut, sums and products of the rows
below it give the next estimate. No group is ever gathered in a task; a
group may hold any share of the rows. Equal vectors of a language and source count once in the estimate, so that
copies of one text, however many, are no bulk. Groups are (language, source), language, and all rows; a
text is judged by the finest one with ``MIN_GROUP`` such rows (null is a language and a source).

A text is rejected if its squared distance is above the chi-square quantile of tail ``TAIL``. The tail is far out since clean
texts' statistics have heavier tails than the normal distribution. Where a text is short, so that its own counting variance is above
its group's, its deviations are scaled down accordingly.

A null text has no words and fails. Repeated rows count and are judged as often as they occur. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from prefspark.llm.common import prepare, save, text_or_empty

MIN_WORDS = 50
MIN_GROUP = 200
KEEP = 0.75
MAX_STEPS = 12  # of concentration; most groups stop after 3 to 6
FALL = 0.01  # of the log determinant, below which a group and start is done
TAIL = 1e-6  # share of normally distributed rows beyond the cutoff
STRETCH = 50  # words in which repeats of single words are counted
BIN = 0.02  # width of a histogram bin in log(1 + squared distance)
VALUE_BIN = 0.001  # the same in log(1 + statistic), for medians
# Fixed values of the contract.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
SYMBOL = re.compile(r"[#*$%&|<>]")

VECTOR = ["symbols", "upper", "word_length", "repeats", "dup_lines", "sameness"]
BASE_SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
               "n_repeat_words long, base_failed boolean, vector array<double>, noise array<double>")
OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def repeat_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(windows)
    if len(count) == len(windows):
        return 0
    covered = bytearray(len(words))
    for k, window in enumerate(windows):
        if count[window] > 1:
            covered[k:k + 3] = b"\1\1\1"
    return sum(covered)


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


def _vector(words: list[str], lines: int, symbols: int, dup: int, repeats: int) -> tuple[list[float], list[float]]:
    """Statistics and the variance that counting gives each. The square root of a count (plus 3/8) has
    a variance of about 1/4 at any share. Repeats come by lines, so that a line is their unit.
    ``sameness`` counts words that occurred before in their stretch, and so does not grow with the text."""
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.ones(1)
    starts = range(0, max(len(words) - STRETCH, 0) + 1, STRETCH)
    within = sum(min(STRETCH, len(words) - k) for k in starts) or 1
    same = within - sum(len(set(words[k:k + STRETCH])) for k in starts) if words else 0
    mean = float(lengths.mean())
    vector = [((symbols + 0.375) / n) ** 0.5, ((sum(map(str.isupper, words)) + 0.375) / n) ** 0.5, float(np.log(mean)),
              (repeats / n + 0.375 / lines) ** 0.5, ((dup + 0.375) / lines) ** 0.5, ((same + 0.375) / within) ** 0.5]
    noise = [0.25 / n, 0.25 / n, float(lengths.var()) / (n * mean * mean), 0.25 / lines, 0.25 / lines, 0.25 / within]
    return vector, noise


def statistics(text: str) -> tuple:
    words = WORD.findall(text)
    chars, symbols = sum(map(len, words)), len(SYMBOL.findall(text))
    dup, repeats = duplicate_lines(text), repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > 50 * len(words)
    return (len(words), chars, symbols, dup, repeats, failed,
            *_vector(words, text.count("\n") + 1, symbols, dup, repeats))


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` (as ``d.<name>``) beside the statistics of its text."""
    prepare(docs.sparkSession)
    structs = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("d"), F.col("text"))

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            stats = [statistics(text_or_empty(t)) for t in batch.column(1).to_pylist()]
            columns = list(zip(*stats, strict=True)) if stats else [[] for _ in range(8)]
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.list_(pa.float64())] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                names=["d", *(c.split()[0] for c in BASE_SCHEMA.split(", "))])

    schema = StructType([StructField("d", structs.schema["d"].dataType), *StructType.fromDDL(BASE_SCHEMA).fields])
    return structs.mapInArrow(rows, schema)


# ---- groups: the finest first ----------------------------------------------------------------

LEVELS = 3


def _group(level: int, lang: Column, source: Column) -> Column:
    """Name of a row's group at a level; null and empty names stay apart."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    parts = [F.lit(str(level))] + [name(lang)] * (level < 2) + [name(source)] * (level < 1)
    return F.concat_ws("\x1f", *parts)


def _sums(rows: DataFrame) -> DataFrame:
    p = len(VECTOR)
    cells = [F.sum(F.col("vector")[i]).alias(f"s{i}") for i in range(p)]
    cells += [F.sum(F.col("noise")[i]).alias(f"e{i}") for i in range(p)]
    cells += [F.sum(F.col("vector")[i] * F.col("vector")[j]).alias(f"q{i}_{j}")
              for i in range(p) for j in range(i, p)]
    return rows.groupBy("grp", "start").agg(F.count("*").alias("n"), *cells)


MODEL = ("grp string, start int, n long, mean array<double>, noise array<double>, scatter array<double>, "
         "precision array<double>, logdet double")


def estimate_row(grp: str, start: int, n: int, mean: np.ndarray, noise: np.ndarray, scatter: np.ndarray,
                 logdet: float | None = None) -> tuple:
    if logdet is None:
        logdet = float(np.linalg.slogdet(scatter)[1])
    return (grp, start, n, mean.tolist(), noise.tolist(), scatter.ravel().tolist(),
            np.linalg.inv(scatter).ravel().tolist(), logdet)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in MODEL.split(", ")])


def widened(scatter: np.ndarray, pooled: np.ndarray) -> np.ndarray:
    """``scatter``, made as wide as ``pooled`` in every direction in which it is narrower."""
    root = np.linalg.cholesky(pooled)
    inverse = np.linalg.inv(root)
    values, axes = np.linalg.eigh(inverse @ scatter @ inverse.T)
    axes = root @ axes
    return (axes * np.maximum(values, 1.0)) @ axes.T


def _estimate(pdf: pd.DataFrame, widen: float) -> pd.DataFrame:
    """Location and scatter (row-major) from a group's sums. ``widen``: the scatter of kept rows
    is too narrow by a factor that depends on ``KEEP``. It is at least the mean counting variance in every direction,
    so that the determinant of a group without symbols or repeats is not nothing."""
    p, out = len(VECTOR), []
    for row in pdf.itertuples(index=False):
        r = row._asdict()
        n = max(int(r["n"]), 1)
        mean = np.array([r[f"s{i}"] for i in range(p)]) / n
        noise = np.array([r[f"e{i}"] for i in range(p)]) / n
        scatter = np.empty((p, p))
        for i in range(p):
            for j in range(i, p):
                scatter[i, j] = scatter[j, i] = r[f"q{i}_{j}"] / n - mean[i] * mean[j]
        scatter = widened(scatter * widen, np.diag(noise + LEAST))
        out.append(estimate_row(r["grp"], int(r["start"]), n, mean, noise, scatter))
    return _frame(out)


LEAST = 1e-9  # variance: keeps the scatter of wholly equal statistics invertible


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function for even ``k``."""
    return 1.0 - chi2_tail(x, k)


def chi2_tail(x: float, k: int) -> float:
    half, term, total = x / 2, 1.0, 0.0
    for i in range(k // 2):
        total += term
        term *= half / (i + 1)
    return float(np.exp(-half) * total)


def chi2_quantile(tail: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_tail(middle, k) > tail else (low, middle)
    return high


# The usual consistency factor of a kept share, and the cutoff.
CONSISTENCY = KEEP / chi2_cdf(chi2_quantile(1 - KEEP, len(VECTOR)), len(VECTOR) + 2)
CUTOFF = chi2_quantile(TAIL, len(VECTOR))


def distance(deviation: list[Column], precision: Column) -> Column:
    """Squared Mahalanobis distance as one expression."""
    p = len(VECTOR)
    total = F.lit(0.0)
    for i in range(p):
        row = F.lit(0.0)
        for j in range(p):
            row = row + precision[i * p + j] * deviation[j]
        total = total + row * deviation[i]
    return F.greatest(total, F.lit(0.0))


def _deviation(vector: Column, mean: Column) -> list[Column]:
    return [vector[i] - mean[i] for i in range(len(VECTOR))]


def _weighted_median(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    running = np.cumsum(counts[order])
    return float(values[order][np.searchsorted(running, running[-1] / 2)])


def _median_start(pdf: pd.DataFrame) -> pd.DataFrame:
    """Medians and median absolute deviations of a group from its histograms, as a diagonal estimate."""
    p = len(VECTOR)
    mean, variance, noise = np.zeros(p), np.zeros(p), np.zeros(p)
    for i, own in pdf.groupby("pos"):
        values = np.expm1((own["bin"].to_numpy() + 0.5) * VALUE_BIN)
        counts = own["n"].to_numpy()
        mean[i] = _weighted_median(values, counts)
        variance[i] = (1.4826 * _weighted_median(np.abs(values - mean[i]), counts)) ** 2
        noise[i] = own["noise"].sum() / counts.sum()
    scatter = np.diag(variance + noise + LEAST)
    return _frame([estimate_row(pdf["grp"].iloc[0], 0, int(pdf["n"].sum()) // p, mean, noise, scatter, np.inf)])


def _starts(rows: DataFrame) -> DataFrame:
    """Two first estimates a group, whose determinant counts as infinite."""
    cells = rows.select("grp", F.posexplode(F.arrays_zip("vector", "noise")).alias("pos", "cell"))
    histogram = cells.groupBy("grp", "pos", F.floor(F.log1p("cell.vector") / VALUE_BIN).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.sum("cell.noise").alias("noise"))  # some thousand bins a group at most
    medians = histogram.groupBy("grp").applyInPandas(_median_start, MODEL)
    moments = _sums(rows.withColumn("start", F.lit(1))).mapInPandas(
        lambda frames: (_estimate(f, 1.0).assign(logdet=np.inf) for f in frames), MODEL)
    return save(medians.unionByName(moments), "mcd-start")


def _concentrate(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step: the next estimate of each group and start."""
    own = ["grp", "start"]
    placed = rows.join(model.select(*own, "mean", "precision"), "grp").select(
        *own, "vector", "noise",
        F.floor(F.log1p(distance(_deviation(F.col("vector"), F.col("mean")), F.col("precision")))
                / BIN).cast("int").alias("bin"))
    histogram = placed.groupBy(*own, "bin").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("bin", "n")))  # some thousand bins at most
    running = F.aggregate(
        "pairs", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("cut")),
        lambda a, x: F.when(a["seen"] >= F.col("need"), a).otherwise(
            F.struct((a["seen"] + x["n"]).alias("seen"), x["bin"].alias("cut"))))
    cuts = save(histogram.groupBy(*own).agg(pairs.alias("pairs"), F.sum("n").alias("total"))
                .withColumn("need", F.ceil(F.col("total") * KEEP))
                .select(*own, running["cut"].alias("cut")), "mcd-cuts")
    kept = placed.join(cuts, own).where(F.col("bin") <= F.col("cut"))
    return save(_sums(kept).mapInPandas(lambda frames: (_estimate(f, CONSISTENCY) for f in frames), MODEL), "mcd-model")


def _no_narrower_than_pooled(model: DataFrame) -> DataFrame:
    """Each group's estimate after the comparison with its level's mean scatter (one row a level)."""
    p, level = len(VECTOR), F.substring("grp", 1, 1)
    cells = [(F.sum(F.col("n") * F.col("scatter")[i]) / F.sum("n")).alias(f"c{i}") for i in range(p * p)]
    pooled = {r[0]: np.array(r[1:]).reshape(p, p) for r in model.groupBy(level).agg(*cells).collect()}

    def wide(frames):
        for pdf in frames:
            yield _frame([estimate_row(r.grp, r.start, r.n, np.asarray(r.mean), np.asarray(r.noise),
                                       widened(np.asarray(r.scatter).reshape(p, p), pooled[r.grp[0]]), r.logdet)
                          for r in pdf.itertuples(index=False)])

    return save(model.mapInPandas(wide, MODEL), "mcd-fitted")


def fit(stats: DataFrame) -> DataFrame:
    """Models (``MODEL``, one row a group) of all groups with ``MIN_GROUP`` different rows. ``stats``: lang,
    source, vector, noise of the rows that passed the base rules."""
    levels = F.array(*[_group(k, F.col("lang"), F.col("source")) for k in range(LEVELS)])
    once = save(stats.groupBy("lang", "source", "vector").agg(F.min("noise").alias("noise")), "mcd-rows")
    rows = once.select(F.explode(levels).alias("grp"), "vector", "noise")
    sizes = save(rows.groupBy("grp").agg(F.count("*").alias("total")).where(F.col("total") >= MIN_GROUP), "mcd-sizes")
    rows = rows.join(sizes.select("grp"), "grp", "left_semi")
    live, found = _starts(rows), None
    for _ in range(MAX_STEPS):
        new = _concentrate(rows, live)
        found = new if found is None else found.unionByName(new)
        before = live.select("grp", "start", F.col("logdet").alias("before"))
        live = save(new.join(before, ["grp", "start"]).where(F.col("logdet") < F.col("before") - FALL).drop("before"),
                    "mcd-live")
        if live.isEmpty():
            break
    names = [c.split()[0] for c in MODEL.split(", ")]
    least = found.groupBy("grp").agg(F.min(F.struct("logdet", *[c for c in names if c not in ("grp", "logdet")])).alias("m"))
    return _no_narrower_than_pooled(save(least.select("grp", *[f"m.{c}" for c in names[1:]]), "mcd-least"))


def judged(stats: DataFrame, model: DataFrame, lang: Column, source: Column) -> DataFrame:
    """``stats`` with ``distance`` (of the finest group that has a model, or null) and ``kept``."""
    p, parts = len(VECTOR), ("mean", "allowed", "precision")
    # by statistic: the group's mean counting variance and its whole variance
    allowed = F.transform(F.arrays_zip("noise", F.array(*[F.col("scatter")[i * p + i] for i in range(p)]).alias("own")),
                          lambda x: F.struct(x["noise"].alias("noise"), x["own"].alias("own")))
    found = stats
    for k in range(LEVELS):
        own = model.select(F.col("grp").alias(f"g{k}"), F.col("mean").alias(f"mean{k}"), allowed.alias(f"allowed{k}"),
                           F.col("precision").alias(f"precision{k}"))
        found = found.withColumn(f"g{k}", _group(k, lang, source)).join(own, f"g{k}", "left")
    mean, allowed, precision = (F.coalesce(*[F.col(f"{c}{k}") for k in range(LEVELS)]) for c in parts)
    beyond = [F.greatest(F.col("noise")[i] - allowed[i]["noise"], F.lit(0.0)) / allowed[i]["own"] for i in range(p)]
    deviation = [d / F.sqrt(1 + b) for d, b in zip(_deviation(F.col("vector"), mean), beyond, strict=True)]
    known = F.when(mean.isNotNull(), distance(deviation, precision))
    return found.withColumn("distance", known).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)).drop(
        *[f"{c}{k}" for c in ("g", *parts) for k in range(LEVELS)])


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): base columns, distance, kept."""
    stats = save(with_statistics(docs, ["doc_id", "lang", "source"]).select("d.*", *OUT, "vector", "noise"),
                 "mcd-stats")
    model = fit(stats.where(~F.col("base_failed")))
    return judged(stats, model, F.col("lang"), F.col("source")).select("doc_id", *OUT, "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns and nothing else. The texts are
    measured twice and never shuffled."""
    stats = save(with_statistics(docs, ["lang", "source"]).select("d.*", "base_failed", "vector", "noise"),
                 "mcd-stats")
    model = fit(stats.where(~F.col("base_failed")).select("lang", "source", "vector", "noise"))
    rows = judged(with_statistics(docs, docs.columns), model, F.col("d.lang"), F.col("d.source"))
    return rows.where("kept").select("d.*")
