"""The two classifiers against plain loops: sites by numpy, features, trees and calibration step by step."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import site_quality, toxicity

DOCS = "doc_id long, text string, lang string, source string"


def corpus(n=400, seed=4):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < (0.9 if i % 5 else 0.3)
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(10, 60))]
        text = " ".join(words) if good else " ".join(w + r.choice(["#", " 77", "", "$$"]) for w in words[:8] * 3)
        rows.append((i, text, r.choice(["en", "fr", None]), f"s{i % 5}"))
        if i % 3 == 0:
            labels.append((i, int(good)))
    return rows, labels


def posterior(evidence, hosts, paths, prior):
    """(site_rate, quality) of each document, by plain sums over floats of millionths."""
    p = np.round(1e6 / (1 + np.exp(-evidence)))

    def shrinkage(n, s, before):
        mean = min(max(s.sum() / 1e6 / n.sum(), 1e-4), 1 - 1e-4)
        q = sum(math.floor(k * (t / 1e6 / k - b) ** 2 * 1e6 + 0.5) for k, t, b in zip(n, s, before)) / 1e6
        within = mean * (1 - mean)
        spread = (q - (len(n) - 1) * within) / max(n.sum() - (n * n).sum() / n.sum(), 1.0)
        return mean, min(max(within / max(spread, 1e-9) - 1, 2.0), 10_000.0)

    sites = sorted(set(zip(hosts, paths)))
    of = lambda keep: np.array([keep(h, x) for h, x in zip(hosts, paths)])
    names = sorted(set(hosts))
    n = np.array([sum(h == a for h in hosts) for a in names], float)
    s = np.array([p[of(lambda h, x: h == a)].sum() for a in names])
    rate, weight = shrinkage(n, s, [p.sum() / 1e6 / len(p)] * len(n))
    prior_of = {a: round((b / 1e6 + rate * weight) / (k + weight), 9) for a, k, b in zip(names, n, s)}
    n = np.array([sum(1 for z in zip(hosts, paths) if z == a) for a in sites], float)
    s = np.array([p[of(lambda h, x: (h, x) == a)].sum() for a in sites])
    _, weight = shrinkage(n, s, [prior_of[a[0]] for a in sites])
    size, total = dict(zip(sites, n)), dict(zip(sites, s))
    out = []
    for e, mine, h, x in zip(evidence, p, hosts, paths):
        at = (h, x)
        rate = ((total[at] - mine) / 1e6 + prior_of[h] * weight) / (size[at] - 1 + weight)
        rate = round(min(max(rate, 1e-4), 1 - 1e-4), 9)
        odds = e - math.log(prior / (1 - prior)) + math.log(rate / (1 - rate))
        out.append((rate, 1 / (1 + math.exp(-odds))))
    return out


def test_posteriors_equal_numpy(spark):
    rows, labels = corpus()
    df = spark.createDataFrame([*rows, rows[3]], DOCS).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = site_quality.classify(df, known).orderBy("doc_id", "evidence").collect()
    every = sorted([*rows, rows[3]], key=lambda x: x[0])
    want = posterior(np.array([g["evidence"] for g in got]), [x[3] for x in every], [x[2] or "" for x in every], float(np.mean([y for _, y in labels])))
    for g, (rate, quality) in zip(got, want):
        assert g["site_rate"] == pytest.approx(rate, abs=2e-9) and g["quality"] == pytest.approx(quality, abs=1e-6)
        assert g["kept"] == (g["quality"] >= 0.5)
    again = site_quality.classify(df.repartition(7), known).orderBy("doc_id", "evidence").collect()
    assert again == got


def test_sites_of_urls(spark):
    urls = ["http://WWW.a.example/x/y?q#z", "https://a.example/x", "https://a.example", "no url", None, "http://b.example:80//p/q"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = site_quality.site_of(F.col("url"))
    got = [tuple(r) for r in df.select(host, path).collect()]
    assert [g[0] for g in got] == ["a.example", "a.example", "a.example", None, None, "b.example"]
    assert [g[1] for g in got][:3] == ["x", "x", ""] and got[5][1] == "p"
    rows, labels = corpus(120)
    docs = spark.createDataFrame([(i, t, f"http://{s}.example/{lang}/{i}") for i, t, lang, s in rows], "doc_id long, text string, url string")
    by_url = site_quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), url="url").orderBy("doc_id").collect()
    columns = spark.createDataFrame([(i, t, str(lang), s) for i, t, lang, s in rows], DOCS)
    assert by_url == site_quality.classify(columns, spark.createDataFrame(labels, "doc_id long, quality int")).orderBy("doc_id").collect()


def plain_features(text, lexicon):
    """The features, one after another, by plain loops."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    n, size, count = max(len(words), 1), max(len(text), 1), Counter(words)
    families = Counter(w[:k] for w in count if len(w) >= 6 for k in (5, 6, 7) if len(w) >= k)
    families = {h: c for h, c in families.items() if c >= 2 and "^" + h in lexicon}
    hits = [w for w in count if w in lexicon]
    you = [i for i, w in enumerate(words) if w in toxicity.YOU]
    near = sum(any(abs(i - j) <= 5 for j in you) for i, w in enumerate(words) if w in hits)
    odds = round(sum(lexicon[w] for w in hits) + sum(lexicon["^" + h] for h in families), 6)
    capitals = [len(x) for x in re.findall("[A-ZÀ-ÖØ-Þ]+", text)]
    out = {
        "words": sum(count[w] for w in hits), "words_kinds": len(hits), "family": max(families.values(), default=0), "family_kinds": len(families),
        "near_you": near, "you_rate": 100 * sum(count[w] for w in toxicity.YOU) / n, "capitals": 100 * sum(capitals) / size,
        "loud": 100 * sum(c >= 3 for c in capitals) / n, "punctuation": 100 * sum(text.count(c) for c in ".,;:!?\"'()") / size,
        "exclamations": 100 * sum(text.count(c) for c in "!?") / size, "odds": odds, "size": math.log1p(len(words)),
    }
    out |= {"words_rate": 100 * out["words"] / n, "family_rate": 100 * sum(families.values()) / n, "near_you_rate": 100 * near / n, "odds_rate": 100 * odds / n}
    return out


def test_features_equal_plain_loops():
    r = random.Random(3)
    lexicon = {"grump": 2.5, "zork": 3.0, "^grump": 2.25, "^snarl": 4.0}
    bits = ["you", "grump", "grumpy", "grumpish", "snarled", "snarling", "ZORK", "Zork!", "plain", "ÉTÉ", "z0rk", "Hm...", "(so)", "\n", "dein", "a1"]
    for _ in range(300):
        text = " ".join(r.choice(bits) for _ in range(r.randint(0, 40)))
        got = dict(zip(toxicity.NAMES, toxicity.features_of(text, lexicon)))
        for name, value in plain_features(text, lexicon).items():
            assert got[name] == pytest.approx(value, abs=1e-9), (name, text)
    hidden = dict(zip(toxicity.NAMES, toxicity.features_of("z0rk and gr*ump and s p a c e d", lexicon)))
    assert hidden["hidden"] == 2 and hidden["obfuscation"] == pytest.approx(100 * 3 / 11, rel=0.2)


def test_a_tree_takes_the_best_split():
    g = np.random.default_rng(1)
    x = g.integers(0, 8, (300, 3)).astype(float)
    y = ((x[:, 1] > 4) ^ (g.random(300) < 0.05)).astype(float)
    t = toxicity.Trees(x, y, rounds=1, depth=1, rate=1.0, ridge=2.0, least=2.0)
    q = np.full(300, y.mean())
    grad, hess = y - q, q * (1 - q)

    def gain(inside):
        return sum(grad[k].sum() ** 2 / (hess[k].sum() + 2.0) for k in (inside, ~inside)) if 2.0 <= hess[inside].sum() <= hess.sum() - 2.0 else -1

    best = max((gain(x[:, j] <= v), j, v) for j in range(3) for v in range(8))
    left = x[:, best[1]] <= best[2]
    margin = t.margin(x)
    for side in (left, ~left):
        assert margin[side] == pytest.approx(t.base + grad[side].sum() / (hess[side].sum() + 2.0), abs=1e-9)


def test_isotonic_is_the_nearest_rising_function():
    g = np.random.default_rng(2)
    for n in (5, 20, 60):
        m = np.sort(g.normal(size=n))
        y = (g.random(n) < 1 / (1 + np.exp(-2 * m))).astype(float)
        # min over ends of max over beginnings of the means between them.
        best = np.array([min(max(y[a : b + 1].mean() for a in range(i + 1)) for b in range(i, n)) for i in range(n)])
        iso = toxicity.Isotonic(m, y)
        pools = {round(v, 12): (best == v) for v in set(best)}
        assert len(iso.y) == len(pools)
        for at, value, (mean, rows) in zip(iso.x, iso.y, sorted(pools.items())):
            assert at == pytest.approx(m[rows].mean()) and value == pytest.approx((y[rows].sum() + 0.01) / (rows.sum() + 0.02))
