"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Every text is turned into counts inside one projection, with no shuffle of
texts. The light statistics are written once; from there each (language,
source) gets a robust centre and scatter: from ``STARTS`` deterministic starts
(medians and quartiles, all rows, and ``STARTS`` - 2 parts of the rows by hash)
concentration steps are taken, each of which keeps the ``SUPPORT`` share of rows
with the least distance and takes their mean and covariance. A start is done when
a step no longer lowers its determinant by ``GAIN``; the start with the least
determinant is the group's estimate. A row is rejected when its squared
Mahalanobis distance is beyond the cut-off.

The estimate is regularised the same way at every size: means and covariances
count as n rows beside ``PRIOR_ROWS`` rows of the language's medians and scales
(which count beside as many of the whole table's), so a source with few rows has a
regular scatter. Variances below a floor are raised to it.

A concentration step is one aggregate: rows add their moments to a
(group, start, distance bin) cell, so a source with a third of all rows is
combined before the shuffle, and a task never holds a group. The order statistic
of the distances is the edge of a fixed logarithmic bin, which makes it exact to
2 % and the same for any partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulant.llm.common import SPACES, discard, let, materialise

WINDOW = 5
SUPPORT = 0.75
STARTS = 4
#: Least fall of the logarithm of the determinant that makes another step.
GAIN = 0.01
#: The upper tail of a chi-squared law beyond which a row is an outlier.
TAIL = 1e-4
PRIOR_ROWS = 50
#: Least standard deviations of the transformed statistics: log words, log word length,
#: root of symbol share, root of duplicate-line share, root of repeated-word share.
FLOORS = (0.5, 0.15, 0.12, 0.15, 0.12)
P = len(FLOORS)
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _repeat_words(words: Column) -> Column:
    """Words in windows of five that occur twice or more in the array.

    Hashes show whether any window repeats at all. Only then windows are
    sorted by (hash, window itself, position), so equal ones are neighbours and
    are told apart by their words, never by the hash alone.
    """

    def at(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i + k) for k in range(WINDOW)]

    def marked(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.struct(F.xxhash64(*at(w, i)).alias("h"), F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("g"), i.alias("i")),
        )

        def positions(s: Column) -> Column:
            last = F.size(s) - 1

            def twin(k: Column) -> Column:
                own = F.get(s, k)["g"]
                before = (k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["g"] == own)
                after = (k < last) & (F.get(s, F.least(k + 1, last))["g"] == own)
                return before | after

            found = F.filter(F.sequence(F.lit(0), last), twin)
            return F.array_sort(F.transform(found, lambda k: F.get(s, k)["i"]))

        def covered(p: Column) -> Column:
            # Starts in order: each adds the words up to the next start, at most a window's length.
            gaps = F.transform(p, lambda x, k: F.when(k + 1 < F.size(p), F.least(F.lit(WINDOW), F.get(p, k + 1) - x)).otherwise(F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(F.sort_array(grams), positions), covered)

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*at(w, i)))
        repeats = F.size(F.array_distinct(hashes)) < F.size(w) - (WINDOW - 1)
        return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).when(repeats, marked(w)).otherwise(F.lit(0).cast("long"))

    return let(words, counted)


def text_statistics(docs: DataFrame, text_col: str = "text") -> list[Column]:
    """Columns with the counts of one text, computed in a projection."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    symbols = (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")
    return [counts.alias("_counts"), line_counts.alias("_lines"), symbols.alias("n_symbols")]


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.log1p(F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


_X = [f"_x{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_BINS_PER_E = 50


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _with_distance(rows: DataFrame) -> DataFrame:
    """Adds ``_d2`` by forward substitution with the Cholesky factor of each row's estimate."""
    out = rows
    for i in range(P):
        rest = F.col(_X[i]) - F.col(f"_m{i}")
        for j in range(i):
            rest = rest - F.col(f"_l{i}{j}") * F.col(f"_y{j}")
        out = out.withColumn(f"_y{i}", rest / F.col(f"_l{i}{i}"))
    d2 = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, P)), F.col("_y0") * F.col("_y0"))
    return out.withColumn("_d2", d2)


_KEYS = ["_lang", "_source"]
_M = [f"_m{i}" for i in range(P)]
_L = [f"_l{i}{j}" for i, j in _PAIRS]


def _factored(est: DataFrame, keep: list[str]) -> DataFrame:
    """From means ``_m`` and covariances ``_c`` to the Cholesky factor ``_l`` and the log determinant; variances are at least the floors."""
    out = est
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"_c{i}{j}")
            if i == j:
                rest = F.greatest(rest, F.lit(FLOORS[i] ** 2))
            for k in range(j):
                rest = rest - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            # what rounding may leave of a variance that the others explain
            value = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 1e4))) if i == j else rest / F.col(f"_l{j}{j}")
            out = out.withColumn(f"_l{i}{j}", value)
    logdet = 2 * sum((F.log(F.col(f"_l{i}{i}")) for i in range(1, P)), F.log("_l00"))
    return out.select(*keep, logdet.alias("_logdet"), *_M, *_L)


def _joined(rows: DataFrame, est: DataFrame) -> DataFrame:
    right = est.select(F.col("_lang").alias("_el"), F.col("_source").alias("_es"), *[c for c in est.columns if c not in _KEYS])
    return rows.join(right, (F.col("_lang") == F.col("_el")) & (F.col("_source") == F.col("_es")), "left")


def _regular(sums: DataFrame, prior: DataFrame, keys: list[str], factor: Column) -> DataFrame:
    """Estimates from sums of moments, beside the prior's rows; ``factor`` makes the covariance of a nearest share consistent."""
    n, all_rows = F.col("_n"), F.col("_n") + PRIOR_ROWS
    own = sums.join(prior, "_lang")
    mean = [F.col(f"_s{i}") / n for i in range(P)]
    cov = {(i, j): factor * (F.col(f"_q{i}{j}") / n - mean[i] * mean[j]) for i, j in _PAIRS}
    return _factored(
        own.select(
            *keys,
            *[((n * mean[i] + PRIOR_ROWS * F.col(f"_pm{i}")) / all_rows).alias(f"_m{i}") for i in range(P)],
            *[((n * cov[i, j] + (PRIOR_ROWS * F.col(f"_pv{i}") if i == j else F.lit(0.0))) / all_rows).alias(f"_c{i}{j}") for i, j in _PAIRS],
        ),
        keys,
    )


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(x).alias(f"_s{i}") for i, x in enumerate(_X)],
        *[F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"_q{i}{j}") for i, j in _PAIRS],
    ]


def _quartiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group ``_n`` and, by statistic, the median ``_c`` and the variance ``_v`` that the quartiles of a normal law would show."""
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(x, at, F.lit(1000)).alias(f"_p{i}") for i, x in enumerate(_X)])
    scale = [(F.get(f"_p{i}", F.lit(2)) - F.get(f"_p{i}", F.lit(0))) / F.lit(1.349) for i in range(P)]
    return found.select(*keys, "_n", *[F.get(f"_p{i}", F.lit(1)).alias(f"_c{i}") for i in range(P)], *[F.greatest(scale[i] * scale[i], F.lit(FLOORS[i] ** 2)).alias(f"_v{i}") for i in range(P)])


def _prior(rows: DataFrame) -> DataFrame:
    """Per language the centre and variances that a group's estimate is drawn to."""
    whole = _quartiles(rows, []).select(*[F.col(f"_{c}{i}").alias(f"_w{c}{i}") for c in "cv" for i in range(P)])
    both = _quartiles(rows, ["_lang"]).join(F.broadcast(whole))  # one row
    drawn = lambda c, i: (F.col("_n") * F.col(f"_{c}{i}") + PRIOR_ROWS * F.col(f"_w{c}{i}")) / (F.col("_n") + PRIOR_ROWS)
    return both.select("_lang", *[drawn("c", i).alias(f"_pm{i}") for i in range(P)], *[drawn("v", i).alias(f"_pv{i}") for i in range(P)])


def _starts(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """One row per group and start."""
    keys = [*_KEYS, "_start"]
    part = F.pmod(F.xxhash64(*_X), F.lit(STARTS - 2)) + 2  # equal rows go together
    parts = rows.withColumn("_start", F.explode(F.array(F.lit(1), part.cast("int")))).groupBy(*keys).agg(*_sums())
    middles = _quartiles(rows, _KEYS).withColumn("_start", F.lit(0))
    moments = middles.select(*keys, "_n", *[(F.col("_n") * F.col(f"_c{i}")).alias(f"_s{i}") for i in range(P)], *[(F.col("_n") * (F.col(f"_c{i}") * F.col(f"_c{j}") + (F.col(f"_v{i}") if i == j else F.lit(0.0)))).alias(f"_q{i}{j}") for i, j in _PAIRS])
    return _regular(moments.unionByName(parts), prior, keys, F.lit(1.0))


def _concentrate(rows: DataFrame, est: DataFrame, prior: DataFrame, factor: float) -> DataFrame:
    """One concentration step: moments of the nearest ``SUPPORT`` share of each group, for each of its starts."""
    keys = [*_KEYS, "_start"]
    bin_of = F.floor(F.log(F.col("_d2") + F.lit(1e-6)) * _BINS_PER_E).cast("int")
    cells = _with_distance(_joined(rows, est).where("_start is not null")).withColumn("_bin", bin_of).groupBy(*keys, "_bin").agg(*_sums())
    group = Window.partitionBy(*keys)  # a group has one row per bin: at most some thousand
    upto = F.sum("_n").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    near = cells.withColumn("_before", F.coalesce(upto, F.lit(0))).withColumn("_all", F.sum("_n").over(group))
    near = near.where(F.col("_before") < SUPPORT * F.col("_all"))
    sums = ["_n", *[f"_s{i}" for i in range(P)], *[f"_q{i}{j}" for i, j in _PAIRS]]
    return _regular(near.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums]), prior, keys, F.lit(factor))


def _estimates(rows: DataFrame) -> DataFrame:
    """The estimate of each group: of all starts, taken until none gets better, that with the least determinant."""
    h = chi2_quantile(SUPPORT, P)
    factor = SUPPORT / chi2_cdf(h, P + 2)  # makes the subset's covariance consistent
    prior = materialise(_prior(rows), "quality-prior")
    # Starts are no estimates: their determinants, of all rows or parts, don't compare.
    best = materialise(_concentrate(rows, _starts(rows, prior), prior, factor).withColumn("_more", F.lit(True)), "quality-start")
    while not best.where("_more").isEmpty():
        step = _concentrate(rows, best.where("_more"), prior, factor)
        new = step.select(*_KEYS, "_start", F.struct("_logdet", *_M, *_L).alias("_new"))
        both = best.join(new, [*_KEYS, "_start"], "left").withColumn("_better", F.coalesce(F.col("_new._logdet") < F.col("_logdet") - GAIN, F.lit(False)))
        pick = [F.when(F.col("_better"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in ("_logdet", *_M, *_L)]
        before, best = best, materialise(both.select(*_KEYS, "_start", *pick, F.col("_better").alias("_more")), "quality-step")
        discard(before)
    least = best.groupBy(*_KEYS).agg(F.min(F.struct("_logdet", "_start", *_M, *_L)).alias("_e"))
    return least.select(*_KEYS, *[F.col(f"_e.{c}").alias(c) for c in (*_M, *_L)])


def judged(docs: DataFrame, lang_col: str, source_col: str, text_col: str, carry: list[str], tail: float) -> DataFrame:
    """Statistics and verdict of every row; ``carry`` are light columns taken along."""
    stats = docs.select(
        *[F.col(c) for c in carry],
        # null languages and sources are groups of their own
        F.coalesce(F.concat(F.lit("v"), F.col(lang_col)), F.lit("n")).alias("_lang"),
        F.coalesce(F.concat(F.lit("v"), F.col(source_col)), F.lit("n")).alias("_source"),
        *text_statistics(docs, text_col),
    ).select(*carry, *_KEYS, "_counts.*", F.col("_lines.n").alias("n_lines"), F.col("_lines.dup").alias("n_dup_lines"), "n_symbols")
    rows = materialise(stats, "quality-stats").select("*", *[v.alias(x) for v, x in zip(_vector(), _X)])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    fit = rows.where(~F.col("base_failed"))
    est = materialise(_estimates(fit), "quality-estimates")
    out = _with_distance(_joined(rows, est))
    far = F.coalesce(F.col("_d2") > F.lit(chi2_quantile(1 - tail, P)), F.lit(False))
    return out.withColumn("distance", F.sqrt("_d2")).withColumn("kept", ~F.col("base_failed") & ~far)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL
) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, kept, distance.

    A null text has no words and fails; null languages and sources are groups
    of their own. Estimates are made from rows that pass the base rules; where
    a group has none, its rows have a null distance and none passes the base
    rules anyway. Repeated rows are judged alike; an empty table gives an empty
    result.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), F.col(lang_col).cast("string").alias("_in_lang"), F.col(source_col).cast("string").alias("_in_source"))
    out = judged(named, "_in_lang", "_in_source", "_t", ["doc_id"], tail)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def drop_low_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Verdicts depend on text, language and source alone. They are joined back by
    id and text digest, so repeated ids with other texts don't mix, and no key is
    hotter than a row given many times.
    """
    renamed = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
    i, t, g, s = (renamed[c] for c in (id_col, text_col, lang_col, source_col))
    rows = rows.withColumn("_sum", F.xxhash64(t, g, s))
    light = judged(rows.withColumns({"_gl": F.col(g).cast("string"), "_gs": F.col(s).cast("string")}), "_gl", "_gs", t, [i, "_sum"], tail)
    kept = light.where("kept").select(F.col(i).alias("_kid"), F.col("_sum").alias("_ksum"))
    same = F.col(i).eqNullSafe(F.col("_kid")) & (F.col("_sum") == F.col("_ksum"))
    return rows.join(kept, same, "left_semi").select(*[F.col(n).alias(c) for c, n in renamed.items()])
