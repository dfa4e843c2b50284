"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression on statistics of a text, fitted on a bounded sample of labelled rows, gives
each document's evidence. The evidence is summed by host and by path of a host; a host's rate is
shrunk toward the global rate, and a path's toward its host's, the more the fewer documents it has.
How much is estimated from the spread of the rates beyond what chance explains (moments). A
document's posterior log-odds are its evidence, less the prior that the classifier was fitted under,
plus those of its path, taken without the document itself.

Sites are named by two columns, or by a column of URLs: its host in lower case without a leading www.,
and the first part of its path. Evidence is summed in millionths, so that sums are exact in any order.
Null texts are empty. Null hosts and paths, and what is no URL, are sites of their own. Without labels
of both kinds every document has even evidence and is kept. Repeated rows count each; of rows that share
a labelled doc_id that with the least features teaches. An empty table gives no rows. Only the columns
named are read, so that others may have any names. Very long texts are read whole, one row at a time.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import SPACES, filled, words
from tessera.session import cut

#: Labelled rows that the classifier is fitted on at most, a sample by hash of doc_id.
FIT_ROWS = 20_000
#: Sites up to which their table is broadcast; a row is about 100 bytes.
BROADCAST_SITES = 20_000
MILLION = 1_000_000
FEATURES = ["word_length", "symbols", "digits", "variety", "runs", "size", "line", "capitals", "same_lines"]


def features(docs: DataFrame) -> DataFrame:
    """All columns of `docs` and the FEATURES, doubles, rounded."""
    t = filled("text")
    f = docs.withColumn("__t", t).withColumn("__w", words("text")).withColumn("__l", F.split(t, "\n", -1))
    n = F.greatest(F.size("__w"), F.lit(1))
    chars = F.greatest(F.length(F.translate("__t", SPACES, "")), F.lit(1))
    share = lambda pattern: F.regexp_count("__t", F.lit(pattern)) / chars
    exprs = [
        F.log(chars / n), F.sqrt(share(r"[#*$%&|<>]")), F.sqrt(share(r"[0-9]")), F.size(F.array_distinct("__w")) / n,
        F.size(F.filter("__w", lambda w, i: w == F.get("__w", i + 1))) / n, F.log1p(F.size("__w")), F.log(n / F.size("__l")),
        F.sqrt(share(r"\p{Lu}")), 1 - F.size(F.array_distinct("__l")) / F.size("__l"),
    ]
    return f.select(*docs.columns, *(F.round(e, 6).alias(f"__{x}") for x, e in zip(FEATURES, exprs)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the constant first) of a logistic regression by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _shrinkage(rates: DataFrame) -> tuple[float, float]:
    """(the mean rate, the documents that a prior counts as): rates(n, s, prior), s in millionths."""
    r = rates.agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.round(F.col("n") * (F.col("s") / MILLION / F.col("n") - F.col("prior")) ** 2 * MILLION).cast("bigint")).alias("q"),
    ).first()
    if not r["n"]:
        return 0.5, 1.0
    mean = min(max(r["s"] / MILLION / r["n"], 1e-4), 1 - 1e-4)
    within = mean * (1 - mean)
    spread = (r["q"] / MILLION - (r["k"] - 1) * within) / max(r["n"] - r["nn"] / r["n"], 1.0)
    return mean, min(max(within / max(spread, 1e-9) - 1, 2.0), 10_000.0)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_of(url: Column) -> tuple[Column, Column]:
    """(host, first part of the path) of a URL; null for what is none."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return host, F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^/*([^/]*)", 1)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", url: str | None = None, least: float = 0.5) -> DataFrame:
    """(doc_id, __body, evidence, site_rate, quality from 0 to 1, kept: quality is at least `least`) of every row.

    labels: doc_id and quality (0 or 1). host, path: the columns that name a site and its parts; url: the column of URLs
    that names both. __body: hash of the text.
    """
    named = site_of(F.col(url)) if url else (F.col(host), F.col(path))
    site = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in named]
    base = docs.select("doc_id", "text", site[0].alias("__host"), site[1].alias("__path"))
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("__y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    sample = features(base.join(F.broadcast(known), "doc_id")).select("doc_id", "__y", *(f"__{x}" for x in FEATURES))
    one = F.min(F.struct(*(f"__{x}" for x in FEATURES))).alias("x")
    rows = sorted((r["doc_id"], r["__y"], *r["x"]) for r in sample.groupBy("doc_id", "__y").agg(one).collect())  # FIT_ROWS at most
    y = np.array([r[1] for r in rows], float)
    if len(y) and 0 < y.mean() < 1:
        mean, scale, w = fit(np.array([r[2:] for r in rows], float), y)
        prior = float(y.mean())
    else:
        mean, scale, w, prior = np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES) + 1), 0.5
    terms = F.lit(float(w[0]))
    for i, x in enumerate(FEATURES):
        terms = terms + (F.col(f"__{x}") - float(mean[i])) * float(w[i + 1] / scale[i])
    scored = features(base).withColumn("evidence", F.round(F.greatest(F.least(terms, F.lit(20.0)), F.lit(-20.0)), 6))
    scored = scored.withColumn("__p", F.round(MILLION / (1 + F.exp(-F.col("evidence")))).cast("bigint"))
    # What the sites need is small; only the documents themselves carry their texts.
    slim = cut(scored.select("doc_id", F.xxhash64("text").alias("__body"), "__host", "__path", "__p", "evidence"))
    paths = cut(slim.groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum("__p").alias("s")))
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = total["s"] / MILLION / total["n"] if total["n"] else 0.5
    rate, weight = _shrinkage(hosts.withColumn("prior", F.lit(float(overall))))
    host_rate = (F.col("s") / MILLION + rate * weight) / (F.col("n") + weight)
    hosts = hosts.select("__host", F.round(host_rate, 9).alias("prior"))
    paths = cut(paths.join(hosts, "__host"))
    _, weight = _shrinkage(paths)
    few = paths.count() <= BROADCAST_SITES
    joined = slim.join(F.broadcast(paths) if few else paths, ["__host", "__path"])
    without = (F.col("s") - F.col("__p")) / MILLION
    site_rate = (without + F.col("prior") * weight) / (F.col("n") - 1 + weight)
    site_rate = F.round(F.greatest(F.least(site_rate, F.lit(1 - 1e-4)), F.lit(1e-4)), 9)
    odds = F.col("evidence") - math.log(prior / (1 - prior)) + _logit(F.col("site_rate"))
    verdict = joined.withColumn("site_rate", site_rate).withColumn("quality", F.round(1 / (1 + F.exp(-odds)), 6))
    return verdict.select("doc_id", "__body", "evidence", "site_rate", "quality", (F.col("quality") >= least).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that the classifier keeps."""
    verdict = classify(docs, labels, **how)
    bad = verdict.where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("__body").alias("__of")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__of"))
    return docs.join(bad, same, "left_anti")
