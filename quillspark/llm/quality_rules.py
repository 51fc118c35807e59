"""Operator 5: base text statistics, then robust multivariate outliers per language and source.

Base statistics come from whole texts in one pass. Texts that pass the base limits get a vector of four transformed statistics
(log mean word length, and square roots of symbols per word, repeated lines per line and repeated-window words per word).
For each group (language, source), each language and all rows together, the minimum-covariance-determinant estimate is searched from three deterministic starts side by side: medians with absolute
deviations, the covariance of squashed scores, and that of the scores' directions. A concentration step keeps the `CORE` share of rows nearest to the centre and takes
their mean and covariance; steps go on until no determinant falls by `GAIN`, and per group the start with the least determinant stays. Each step is a grouped aggregate over the
statistics table (sums of x and x x', and a quantile sketch of the distances), so no group's rows meet in one task.

An estimate of n rows counts n / (n + `PRIOR`) in its group; the rest comes from the language's estimate, and for a language from that of all rows. That holds at
every size, so small groups lean on their language. A row is rejected when its squared Mahalanobis distance to its group's estimate is over `CUTOFF`.

`FLOOR` squared is added to each variance: where clean texts hardly vary, it keeps slight deviations from being outliers. It's small enough
that each statistic alone can reject a text (`ALONE`).

Defined cases: null and empty texts have all statistics 0 and fail the base limits; null language or source counts as ''; repeated rows
each count; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces, texts_of, window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
FEATURES = 4
#: Share of a group's rows in its core, most steps (each start falls quickly), least fall of a determinant that counts, rows that a parent's estimate is worth.
CORE, STEPS, GAIN, PRIOR = 0.55, 8, 1e-3, 60
#: A core's covariance is too small by this factor: the mean of chi-square with four degrees of freedom over that of its lower `CORE` part.
CONSISTENT = 1.956
#: The 0.9999 quantile of chi-square with four degrees of freedom.
CUTOFF = 23.5127
#: Deviations at which each statistic alone is an outlier where clean texts don't vary in it: a mean word length 1.6 times the centre's,
#: and from a centre of 0, one symbol in ten words, four repeated lines in ten, 26 repeated words in a hundred.
ALONE = (math.log(1.6), math.sqrt(0.1), math.sqrt(0.4), math.sqrt(0.26))
FLOOR = tuple(x / math.sqrt(CUTOFF) for x in ALONE)


def statistics(text: str) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)"""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = 0
    if len(words) > WINDOW:
        h = window_hashes(word_hashes(words), WINDOW)
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        cover = np.zeros(len(words) + 1, np.int64)
        at = np.flatnonzero(count[inverse] > 1)
        cover[at] += 1
        np.subtract.at(cover, at + WINDOW, 1)
        repeat = int((np.cumsum(cover)[:-1] > 0).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat, len(lines)


def text_statistics(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in pieces(batches):
            cols = list(zip(*map(statistics, texts_of(b)), strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(2), b.column(3), *(pa.array(c, pa.int64()) for c in cols)], names=["id", "lang", "source", *names]
            )

    schema = "id long, lang string, source string, " + ", ".join(f"{n} long" for n in names)
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(id_col, text_col, some(lang_col).alias("_l"), some(source_col).alias("_s")).mapInArrow(run, schema)


def features() -> list[Column]:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [
        F.log(F.greatest(F.col("word_chars") / F.greatest("n_words", F.lit(1)), F.lit(1.0))),
        share("n_symbols", "n_words"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]


X = [f"x{i}" for i in range(FEATURES)]
PAIRS = [(i, j) for i in range(FEATURES) for j in range(i, FEATURES)]


def distance(centre: str, inverse: str) -> Column:
    """Squared Mahalanobis distance with the inverse's upper triangle as an array."""
    d = [F.col(x) - F.col(centre)[i] for i, x in enumerate(X)]
    terms = [d[i] * d[j] * F.col(inverse)[k] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)]
    return sum(terms[1:], terms[0])


def matrix(c) -> np.ndarray:
    """The symmetric matrix of an upper triangle, with FLOOR squared added to the variances."""
    m = np.diag(np.square(FLOOR))
    for (i, j), v in zip(PAIRS, c, strict=True):
        m[i, j] += v
        m[j, i] = m[i, j]
    return m


def inverse_of(cov: Column) -> Column:
    """Upper triangle of the inverse of each covariance (upper triangle), with FLOOR squared added to the variances, and behind it the logarithm of the determinant."""

    @F.pandas_udf("array<double>")
    def inverse(cov):
        import pandas as pd

        def one(c):
            m = matrix(c)
            inv = np.linalg.inv(m)
            return [*(float(inv[i, j]) for i, j in PAIRS), float(np.linalg.slogdet(m)[1])]

        return pd.Series([one(c) for c in cov])

    return inverse(cov)


LOG_DET = len(PAIRS)


def starts(rows: DataFrame) -> DataFrame:
    """(grp, start, centre, inverse): three starts for each group of rows(grp, x0..)."""
    middle = rows.groupBy("grp").agg(*(F.percentile_approx(x, 0.5).alias(f"m{i}") for i, x in enumerate(X)))
    apart = rows.join(middle, "grp")
    scale = apart.groupBy("grp").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(FEATURES)), *(F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5).alias(f"s{i}") for i, x in enumerate(X)))
    # A deviation is never below FLOOR's.
    scale = materialise(scale.select("grp", *(f"m{i}" for i in range(FEATURES)), *(F.greatest(F.col(f"s{i}") * 1.4826, F.lit(FLOOR[i])).alias(f"s{i}") for i in range(FEATURES))), "scales")
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(X)]
    scored = rows.join(scale, "grp").withColumns({f"z{i}": v for i, v in enumerate(z)})
    far = F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(1, FEATURES)), F.col("z0") ** 2)) + 1e-9
    squashed, turned = [F.tanh(F.col(f"z{i}")) for i in range(FEATURES)], [F.col(f"z{i}") / F.col("far") for i in range(FEATURES)]
    shapes = scored.withColumn("far", far).groupBy("grp").agg(
        F.array(*(F.coalesce(F.covar_pop(squashed[i], squashed[j]), F.lit(0.0)) for i, j in PAIRS)).alias("a"), F.array(*(F.coalesce(F.avg(turned[i] * turned[j]), F.lit(0.0)) for i, j in PAIRS)).alias("b")
    )
    j = shapes.join(scale, "grp")
    # Scores' covariances in the statistics' own scale; the diagonal keeps the robust deviations.
    own = lambda c: F.array(*(F.col(f"s{i}") * F.col(f"s{k}") * (F.lit(1.0) if i == k else F.col(c)[p] / F.sqrt((F.col(c)[PAIRS.index((i, i))] + 1e-9) * (F.col(c)[PAIRS.index((k, k))] + 1e-9)) * 0.99) for p, (i, k) in enumerate(PAIRS)))
    plain = F.array(*(F.col(f"s{i}") ** 2 if i == k else F.lit(0.0) for i, k in PAIRS))
    begin = F.explode(F.array(*(F.struct(F.lit(k).alias("start"), c.alias("cov")) for k, c in enumerate((plain, own("a"), own("b"))))))
    out = j.select("grp", F.array(*(F.col(f"m{i}") for i in range(FEATURES))).alias("centre"), begin.alias("b")).select("grp", "b.start", "centre", "b.cov")
    return out.select("grp", "start", "centre", inverse_of(F.col("cov")).alias("inverse"))


def concentrated(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One step: (grp, start, n, centre, cov) of the `CORE` share of each group's rows nearest to each start."""
    near = rows.join(model.select("grp", "start", "centre", "inverse"), "grp").withColumn("d", distance("centre", "inverse"))
    limit = near.groupBy("grp", "start").agg(F.percentile_approx("d", CORE, 1000).alias("limit"), F.count(F.lit(1)).alias("n"))
    core = near.join(limit, ["grp", "start"]).where("d <= limit")
    mean, cov = [F.avg(x) for x in X], [F.covar_pop(X[i], X[j]) for i, j in PAIRS]
    return core.groupBy("grp", "start").agg(F.first("n").alias("n"), F.array(*mean).alias("centre"), F.array(*cov).alias("cov"))


def estimates(rows: DataFrame) -> DataFrame:
    """(grp, n, centre, cov) with the least determinant that the starts of each group of rows(grp, x0..) reach."""
    model = materialise(starts(rows), "estimates").withColumn("log_det", F.lit(float("inf")))
    for _ in range(STEPS):
        step = concentrated(rows, model).withColumn("inverse", inverse_of(F.col("cov")))
        last = model.select("grp", "start", F.col("log_det").alias("before"))
        model = materialise(step.withColumn("log_det", F.col("inverse")[LOG_DET]).join(last, ["grp", "start"]), "estimates")
        if model.where(F.col("before") - F.col("log_det") > GAIN).isEmpty():
            break
    best = model.groupBy("grp").agg(F.min_by(F.struct("n", "centre", "cov"), F.struct("log_det", "start")).alias("e")).select("grp", "e.*")
    return materialise(best.withColumn("cov", F.transform("cov", lambda v: v * CONSISTENT)), "estimates")


ALL = "\u0001all"


def shrunken(of: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, centre, inverse): each group's estimate drawn towards its language's, and that towards the estimate of all rows."""
    level = lambda c: of.select(F.col("grp").alias(c), F.struct(F.col("n").cast("double").alias("n"), "centre", "cov").alias(f"e_{c}"))
    j = groups.withColumn("own", own_group()).withColumn("all", F.lit(ALL)).withColumn("language", language_group())
    for c in ("own", "language", "all"):
        j = j.join(level(c), c)

    def mixed(n, a, b):
        w = n / (n + PRIOR)
        return F.zip_with(a, b, lambda x, y: x * w + y * (1 - w))

    for part in ("centre", "cov"):
        lang = mixed(F.col("e_language.n"), F.col(f"e_language.{part}"), F.col(f"e_all.{part}"))
        j = j.withColumn(part, mixed(F.col("e_own.n"), F.col(f"e_own.{part}"), lang))
    return materialise(j.select("lang", "source", "centre", inverse_of(F.col("cov")).alias("inverse")), "estimates")


def own_group() -> Column:
    return F.concat(F.lit("g"), "lang", F.lit("\u0001"), "source")


def language_group() -> Column:
    return F.concat(F.lit("l"), "lang")


def judge_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of `df`: `id_col`, the statistics, base_failed, kept, distance (null where base_failed)."""
    stats = text_statistics(df, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    stats = stats.withColumn("base_failed", failed).withColumns(dict(zip(X, features(), strict=True)))
    stats = materialise(stats, "text-statistics")
    passed = stats.where("not base_failed")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # Each row counts in its own group, its language's and that of all rows.
    rows = passed.select(F.explode(F.array(own_group(), language_group(), F.lit(ALL))).alias("grp"), *X)
    model = shrunken(estimates(rows), passed.select("lang", "source").distinct())
    judged = passed.select("id", "lang", "source", *names, *X).join(model, ["lang", "source"]).withColumn("distance", distance("centre", "inverse"))
    out = judged.select("id", *names, F.lit(False).alias("base_failed"), (F.col("distance") <= CUTOFF).alias("kept"), "distance")
    bad = stats.where("base_failed").select("id", *names, "base_failed", F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return out.unionByName(bad).withColumnRenamed("id", id_col)
