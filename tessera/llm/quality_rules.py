"""Quality rules: statistics of a text, and robust outliers among their vectors. DataFrame functions only.

Words are runs without white space (\\x20, \\x09-\\x0D). A text fails the base rules with fewer than
MIN_WORDS words, or if more than MAX_REPEAT per cent of its words lie in windows of WINDOW words
that the text holds twice or more.

The others become vectors: log of the mean word length, log of symbols per 100 word characters,
log of repeated lines, root of the share of repeated words; each in whole steps of 1/SCALE, so that
sums are exact in any order. For each language, and then for each language and source, the minimum
covariance determinant is estimated: from each of two starts, concentration steps keep half of the
rows (more exactly (n + D + 1) / 2, parts of a bin of equal distances counting in part), nearest by
Mahalanobis distance, and take their means and covariances anew, until the determinant falls no more;
the start with the least determinant counts. The rows within the usual quantile of that estimate then
give the final one. Starts: medians and quartiles; for a language the means and covariances of all its
rows, for a source its language's estimate.

Small groups are shrunk, and by no switch: a source's rows are joined by PRIOR_ROWS rows of its
language's mean and covariance at every step, so that a source of few rows has nearly its language's
estimate and one of many its own. Deviations below FLOOR are added to the covariances, since most texts
have no symbols or repeated lines at all. A vector beyond CUTOFF is rejected.

Distances are cut from histograms with bounded numbers of steps, which are aggregated map-side, so that
no task gathers a group. Null texts have no words and fail. Null languages and sources are groups of
their own. Repeated rows count each. An empty table gives no rows. Only doc_id, text, lang and source
are read, so that other columns may have any names. Very long texts are read whole, one row at a time.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import SPACES, filled, words
from tessera.session import cut

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
SCALE, PRIOR_ROWS = 1024, 30
#: Concentration steps at most, the least fall of a determinant's logarithm that counts, and bins of a distance's logarithm.
STEPS, FALL, BINS = 6, 1e-3, 128
#: Standard deviations that every coordinate has besides its own, in the units of the vectors. The largest value that the
#: base rules leave of the last coordinate, 0.55, is beyond the cutoff on its own.
FLOOR = (0.06, 0.25, 0.35, 0.1)
D = len(FLOOR)
#: Quantiles of chi-square with 4 degrees of freedom: 0.975, within which rows give the final estimate, and 0.99999,
#: beyond which a vector is rejected.
WITHIN, CUTOFF = 11.143287, 28.473255
#: Groups up to which a table of estimates is broadcast; a row is about 200 bytes.
BROADCAST_GROUPS = 20_000


def base_statistics(docs: DataFrame) -> DataFrame:
    """All columns of `docs` (of equal names replaced), and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = filled("text")
    stats = (
        docs.withColumn("__w", words("text"))
        .withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
        .withColumn(
            "__g",
            F.when(
                F.size("__h") >= WINDOW,
                F.transform(F.sequence(F.lit(0), F.size("__h") - WINDOW), lambda i: F.xxhash64(*(F.get("__h", i + j) for j in range(WINDOW)))),
            ),
        )
        .withColumn("__s", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), F.array_sort(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
        .withColumn(
            "__p",
            F.array_sort(F.transform(
                F.filter("__s", lambda s, i: F.coalesce(s["g"] == F.get("__s", i - 1)["g"], F.lit(False)) | F.coalesce(s["g"] == F.get("__s", i + 1)["g"], F.lit(False))),
                lambda s: s["i"],
            )),
        )
        .withColumn("__lines", F.filter(F.split(t, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0))
    )
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
    covered = F.aggregate(
        "__p", start, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(p - a["last"], F.lit(WINDOW))).alias("sum")), lambda a: a["sum"]
    )
    out = {
        "n_words": F.size("__w"),
        "word_chars": F.length(F.translate(t, SPACES, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    kept = [c for c in docs.columns if c not in out]
    return stats.select(*kept, *(c.cast("bigint").alias(n) for n, c in out.items()))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _vector() -> list[Column]:
    chars, n = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    raw = [F.log(chars / n), F.log1p(100 * F.col("n_symbols") / chars), F.log1p("n_dup_lines"), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(x * SCALE).cast("bigint") for x in raw]


def _attach(rows: DataFrame, groups: DataFrame, on: list[str], few: bool, how: str = "inner") -> DataFrame:
    """Joins a table of groups to rows; broadcast only if the groups were counted and are few."""
    return rows.join(F.broadcast(groups) if few else groups, on, how)


def _mahalanobis(x: list[Column]) -> Column:
    """Squared distance, from columns m<i> and the covariance's lower Cholesky factor l<i>_<j>."""
    y: list[Column] = []
    for i in range(D):
        rest = reduce(lambda a, j: a - F.col(f"l{i}_{j}") * y[j], range(i), x[i] - F.col(f"m{i}"))
        y.append(rest / F.col(f"l{i}_{i}"))
    return reduce(lambda a, b: a + b, (v * v for v in y))


PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def _factor(moments: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Means, covariances c<i>_<j> times `factor`, and with floors their Cholesky factor and determinant's logarithm, logdet.

    moments: keys, n, s<i>, s<i>_<j>, and the prior's weight nu, means p<i> and covariances p<i>_<j>, which join as rows would.
    """
    f = moments.withColumn("w", F.col("n") + F.col("nu"))
    for i in range(D):
        f = f.withColumn(f"m{i}", (F.col(f"s{i}") + F.col("nu") * F.col(f"p{i}")) / F.col("w"))
    for i, j in PAIRS:
        given = F.col("nu") * (F.col(f"p{i}_{j}") / factor + F.col(f"p{i}") * F.col(f"p{j}"))
        c = ((F.col(f"s{i}_{j}") + given) / F.col("w") - F.col(f"m{i}") * F.col(f"m{j}")) * factor
        f = f.withColumn(f"c{i}_{j}", F.greatest(c, F.lit(0.0)) if i == j else c)
    for i, j in PAIRS:
        c = F.col(f"c{i}_{j}") + (F.lit((FLOOR[i] * SCALE) ** 2) if i == j else F.lit(0.0))
        c = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}"), range(j), c)
        f = f.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(c, F.lit(1e-3))) if i == j else c / F.col(f"l{j}_{j}"))
    logdet = reduce(lambda a, b: a + b, (F.log(f"l{i}_{i}") for i in range(D))) * 2
    return f.withColumn("logdet", logdet).select(*keys, "logdet", *(f"m{i}" for i in range(D)), *(f"c{i}_{j}" for i, j in PAIRS), *(f"l{i}_{j}" for i, j in PAIRS))


def _consistency(share: float) -> float:
    """The covariance of a normal variable in D = 4 dimensions over that of its `share` nearest to the mean."""
    lo, hi = 0.0, 200.0
    for _ in range(200):
        q = (lo + hi) / 2
        lo, hi = (q, hi) if 1 - math.exp(-q / 2) * (1 + q / 2) < share else (lo, q)
    return share / (1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8))


KEYS = ["__lang", "__source"]
OWN = [*(f"m{i}" for i in range(D)), *(f"l{i}_{j}" for i, j in PAIRS)]


def _sums(weight: Column | None = None) -> list[Column]:
    """n, s<i> and s<i>_<j> of whole numbers, exact in any order; of the rows where `weight` holds."""
    only = lambda c: c if weight is None else F.when(weight, c)
    x = [F.col(f"x{i}") for i in range(D)]
    return [F.count(only(F.lit(1))).alias("n"), *(F.sum(only(x[i])).alias(f"s{i}") for i in range(D)), *(F.sum(only((x[i] * x[j]).cast("decimal(38,0)"))).alias(f"s{i}_{j}") for i, j in PAIRS)]


def _starts(rows: DataFrame, prior: DataFrame, few: bool, shrunk: bool) -> DataFrame:
    """KEYS, start, OWN and a logdet of null, by start 0 and 1."""
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("v")) for i in range(D)))).alias("c")
    counts = rows.select(*KEYS, parts).groupBy(*KEYS, "c.i", "c.v").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*KEYS, "i")
    ranked = counts.withColumn("upto", F.sum("n").over(by.orderBy("v"))).withColumn("all", F.sum("n").over(by))
    at = {q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("v"))) for q in (0.25, 0.5, 0.75)}
    middle = ranked.groupBy(*KEYS).pivot("i", list(range(D))).agg(at[0.5].alias("mid"), (at[0.75] - at[0.25]).alias("wide"))
    cols = [F.col(f"{i}_mid").cast("double").alias(f"m{i}") for i in range(D)]
    for i, j in PAIRS:
        own = F.sqrt((F.col(f"{i}_wide") / 1.349) ** 2 + F.lit((FLOOR[i] * SCALE) ** 2))
        cols.append((own if i == j else F.lit(0.0)).alias(f"l{i}_{j}"))
    first = middle.select(*KEYS, F.lit(0).alias("start"), *cols)
    if shrunk:
        second = prior.select(*KEYS, F.lit(1).alias("start"), *(F.col(f"q_{c}").alias(c) for c in OWN))
    else:
        second = _factor(_attach(rows.groupBy(*KEYS).agg(*_sums()), prior, KEYS, few), KEYS, 1.0).select(*KEYS, F.lit(1).alias("start"), *OWN)
    return first.unionByName(second).withColumn("logdet", F.lit(None).cast("double"))


def concentrated(rows: DataFrame, prior: DataFrame, few: bool, shrunk: bool) -> DataFrame:
    """KEYS, logdet and OWN of the least determinant. rows: KEYS and x0 .. x3. prior: KEYS, nu, p<i>, p<i>_<j>, and q_m<i>,
    q_l<i>_<j>, its floored estimate, where groups are `shrunk`. few: whether the groups are."""
    x, by = [F.col(f"x{i}") for i in range(D)], [*KEYS, "start"]
    sizes = rows.groupBy(*KEYS).agg(F.count("*").alias("size"))
    target = sizes.select(*KEYS, F.least(F.col("size"), F.floor((F.col("size") + D + 1) / 2)).alias("target"))
    prior = prior.select(*KEYS, "nu", *(f"p{i}" for i in range(D)), *(f"p{i}_{j}" for i, j in PAIRS), *(c for c in prior.columns if c.startswith("q_")))
    found = cut(_starts(rows, prior, few, shrunk).join(target, KEYS).withColumn("moving", F.lit(True)))
    factor = _consistency(0.5)
    for _ in range(STEPS):
        moving = found.where("moving").select(*by, "target", *OWN)
        near = _attach(rows, moving, KEYS, few).withColumn("bin", F.floor(F.log1p(_mahalanobis(x)) * BINS)).select(*by, "target", "bin", *(f"x{i}" for i in range(D)))
        bins = near.groupBy(*by, "target", "bin").agg(F.count("*").alias("n"))
        bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("bin")))
        edge = bins.where(F.col("upto") >= F.col("target")).groupBy(*by).agg(
            F.min("bin").alias("edge"), F.min_by((F.col("target") - F.col("upto") + F.col("n")) / F.col("n"), "bin").alias("part")
        )
        core = _attach(near, edge, by, few).where("bin <= edge")
        inner = core.groupBy(*by, "part").agg(*_sums(F.col("bin") < F.col("edge")), *(c.alias(f"e_{n}") for n, c in zip(_names(), _sums(F.col("bin") == F.col("edge")))))
        sums = inner.select(*by, *((F.coalesce(n, F.lit(0)).cast("double") + F.col("part") * F.col(f"e_{n}").cast("double")).alias(n) for n in _names()))
        new = _factor(_attach(sums, prior, KEYS, few), by, factor).select(*by, *(F.col(c).alias(f"new_{c}") for c in ("logdet", *OWN)))
        both = found.join(new, by, "left")
        falls = F.col("new_logdet").isNotNull() & (F.col("logdet").isNull() | (F.col("new_logdet") < F.col("logdet") - FALL))
        found = cut(both.select(*by, "target", falls.alias("moving"), *(F.when(falls, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("logdet", *OWN))))
        if found.where("moving").isEmpty():
            break
    return found.groupBy(*KEYS).agg(F.min_by(F.struct("logdet", *OWN), F.struct("logdet", "start")).alias("best")).select(*KEYS, "best.*")


def estimates(rows: DataFrame, prior: DataFrame, few: bool, shrunk: bool) -> DataFrame:
    """KEYS, m<i>, c<i>_<j>, l<i>_<j>: of the rows within the usual quantile of the least determinant's estimate, with the prior."""
    x, best = [F.col(f"x{i}") for i in range(D)], concentrated(rows, prior, few, shrunk)
    within = _attach(rows, best, KEYS, few).where(F.round(_mahalanobis(x), 6) <= WITHIN).groupBy(*KEYS).agg(*_sums())
    # Every group has rows within: its core has some nearer than D on average.
    final = best.select(*KEYS).join(within, KEYS, "left").na.fill(0)
    return cut(_factor(_attach(final, prior, KEYS, few).withColumn("n", F.greatest("n", F.when(F.col("nu") > 0, 0).otherwise(1))), KEYS, _consistency(0.975)))


def _names() -> list[str]:
    return ["n", *(f"s{i}" for i in range(D)), *(f"s{i}_{j}" for i, j in PAIRS)]


def reject_outliers(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance (squared; null if failed) and kept, for every row of `docs`."""
    named = docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"))
    stats = cut(base_statistics(named).drop("text").withColumn("base_failed", base_failed()).select("*", *(v.alias(f"x{i}") for i, v in enumerate(_vector()))))
    good = stats.where("NOT base_failed")
    x = [f"x{i}" for i in range(D)]
    groups = cut(good.select("lang", "source").distinct())
    few = groups.count() <= BROADCAST_GROUPS
    by_lang = good.select(F.col("lang").alias("__lang"), F.lit("*").alias("__source"), *x)
    none = [F.lit(0.0).alias(c) for c in (*(f"p{i}" for i in range(D)), *(f"p{i}_{j}" for i, j in PAIRS))]
    free = groups.select(F.col("lang").alias("__lang"), F.lit("*").alias("__source")).distinct().select("*", F.lit(0.0).alias("nu"), *none)
    langs = estimates(by_lang, free, few, False)
    given = [*(F.col(f"m{i}").alias(f"p{i}") for i in range(D)), *(F.col(f"c{i}_{j}").alias(f"p{i}_{j}") for i, j in PAIRS), *(F.col(c).alias(f"q_{c}") for c in OWN)]
    prior = groups.select(F.col("lang").alias("__lang"), F.col("source").alias("of")).join(langs.drop("__source"), "__lang")
    prior = cut(prior.select("__lang", F.col("of").alias("__source"), F.lit(float(PRIOR_ROWS)).alias("nu"), *given))
    own = estimates(good.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *x), prior, few, True)
    own = own.select(F.col("__lang").alias("lang"), F.col("__source").alias("source"), *OWN)
    joined = _attach(stats, own, ["lang", "source"], few, "left")
    distance = F.when(~F.col("base_failed"), F.round(_mahalanobis([F.col(f"x{i}") for i in range(D)]), 6))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"),
        F.coalesce(~F.col("base_failed") & (distance <= CUTOFF), F.lit(False)).alias("kept"),
    )
