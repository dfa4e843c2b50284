"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A text's features are densities of a lexicon's words, nearness of those to words of the second
person, and rates of capitals, punctuation and obfuscation. The lexicon is learned from labelled
rows: words, and beginnings of words of which a toxic text holds several different ones. The rows
that may teach are sampled by hash, FIT_ROWS at most, and divided into three parts: one for the
lexicon, one for the trees, one for the calibration; so none is misled by the fit of another. The
trees are fitted on the driver, whose rows have about twenty numbers each. Scoring is one pass.

Language, source and doc_id are no features. Null and empty texts have features of zero and get a score
like any other. Labels other than 0 and 1 are left out. With labels of only one kind, or none, every
score is that kind's rate, or 0. Rows without doc_id are scored and never teach. Repeated rows are
scored each. An empty table gives no rows. Only doc_id and text are read, so that other columns may have
any names. A very long text is one row of a batch bounded by bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, small_batches

#: Labelled rows that teach at most.
FIT_ROWS = 15_000
#: Entries of the lexicon, the toxic texts that an entry needs, and the least odds ratio (logarithm).
ENTRIES, LEAST_TEXTS, LEAST_ODDS = 400, 6, 2.0
#: Characters of the beginnings that stand for families of words.
HEADS = (5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")
#: Obfuscations: digits or signs among letters, long runs of a character, letters set apart.
_DIGITS = re.compile(r"[^\W\d_]+\d\w*|\d+[^\W\d_]\w*")
_SIGNS = re.compile(r"[^\W\d_]+(?:[*@$!#]+[^\W\d_]+)+")
_RUNS = re.compile(r"(\w)\1\1\1+")
_APART = re.compile(r"\b[^\W\d_](?:[ .\-*][^\W\d_]){3,}\b")
_DIGIT, _SIGN = re.compile(r"\d"), frozenset("*@$!#")
_CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]+")
#: Words of the second person in English, German, French and Spanish, and look-alike characters.
YOU = frozenset("you your yours yourself ye u du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo tus vosotros vuestro".split())
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
NAMES = [
    "words", "words_rate", "words_kinds", "family", "family_rate", "family_kinds", "near_you", "near_you_rate", "you_rate", "capitals", "loud",
    "punctuation", "exclamations", "obfuscation", "hidden", "hidden_rate", "odds", "odds_rate", "size",
]


def _units(words: list[str]) -> tuple[Counter, dict[str, int]]:
    """Counts of the words, and of each beginning the number of different words."""
    count, heads = Counter(words), {}
    for w in count:
        if len(w) > HEADS[0]:
            for k in HEADS:
                if len(w) >= k:
                    h = w[:k]
                    heads[h] = heads.get(h, 0) + 1
    return count, heads


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Log odds by entry: a word, or "^" and a beginning of words. rows: text, y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = (Counter(), Counter())
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                count, heads = _units(_WORD.findall((text or "").lower()))
                seen[y].update(count.keys())
                seen[y].update("^" + h for h, n in heads.items() if n > 1)
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([seen[y][k] for k in keys], pa.int64()) for y in (0, 1))], names=["entry", "clean", "toxic"]
            )

    sums = rows.mapInArrow(run, "entry string, clean bigint, toxic bigint").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kinds = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = kinds.get(0, 0), kinds.get(1, 0)
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    best = sums.where(F.col("toxic") >= LEAST_TEXTS).withColumn("odds", F.round(odds, 6)).where(F.col("odds") >= LEAST_ODDS)
    best = best.orderBy(F.desc(F.round(F.col("odds") * F.sqrt("toxic"), 6)), "entry").limit(ENTRIES)
    return {r["entry"]: r["odds"] for r in best.collect()}


def features_of(text: str | None, lexicon: dict[str, float]) -> list[float]:
    text = text or ""
    words = _WORD.findall(text.lower())
    n, size = max(len(words), 1), max(len(text), 1)
    count, heads = _units(words)
    hits = {w: c for w in count.keys() & lexicon.keys() for c in [count[w]]}
    families = {h: c for h in heads for c in [heads[h]] if c > 1 and "^" + h in lexicon}
    total, kinds = sum(hits.values()), sum(families.values())
    odds = round(sum(lexicon[w] for w in hits) + sum(lexicon["^" + h] for h in families), 6)
    near = 0
    you = [i for i, w in enumerate(words) if w in YOU] if hits else []
    if you:
        at = np.array([i for i, w in enumerate(words) if w in hits])
        to = np.searchsorted(you, at)
        spots = np.array([-10, *you, len(words) + 10])
        near = int((np.minimum(at - spots[to], spots[to + 1] - at) <= 5).sum())
    n_you = sum(count[w] for w in count.keys() & YOU)
    hidden = 0
    mixed = _DIGITS.findall(text) if _DIGIT.search(text) else []
    if not _SIGN.isdisjoint(text):
        mixed += _SIGNS.findall(text)
    mixed += [m[0] for m in _RUNS.finditer(text)] + _APART.findall(text)
    for m in mixed:
        plain = re.sub(r"[^\w]", "", m.lower().translate(LOOKALIKES))
        hidden += plain in lexicon and m.lower() not in hits
    runs = list(map(len, _CAPITAL.findall(text)))
    capitals, loud = sum(runs), sum(r > 2 for r in runs)
    marks, bangs = sum(map(text.count, ".,;:!?\"'()")), text.count("!") + text.count("?")
    return [
        total, 100 * total / n, len(hits), max(families.values(), default=0), 100 * kinds / n, len(families), near, 100 * near / n,
        100 * n_you / n, 100 * capitals / size, 100 * loud / n, 100 * marks / size, 100 * bangs / size, 100 * len(mixed) / n, hidden,
        100 * hidden / n, odds, 100 * odds / n, float(np.log1p(len(words))),
    ]


class Trees:
    """Gradient-boosted trees of a fixed depth for a binary label, on features cut into at most 64 steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, ridge: float = 2.0, least: float = 2.0):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1])) for c in x.T]
        self.depth, self.trees = depth, []
        bins = self._bins(x)
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            grad, hess = y - q, q * (1 - q)
            node, splits = np.zeros(len(y), int), []
            for level in range(depth):
                found = [self._split(bins, grad, hess, node == k, ridge, least) for k in range(1 << level)]
                splits.append(found)
                feature, cut = np.array(found).T
                node = 2 * node + (bins[np.arange(len(y)), feature[node]] > cut[node])
            g, h = (np.bincount(node, v, 1 << depth) for v in (grad, hess))
            leaf = rate * g / (h + ridge)
            f += leaf[node]
            self.trees.append((splits, leaf))

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)]).astype(np.uint8)

    def _split(self, bins, grad, hess, inside, ridge, least) -> tuple[int, int]:
        """The feature and the last step that goes left; (0, 255) sends all left."""
        best, where = 1e-6, (0, 255)
        b, g, h = bins[inside], grad[inside], hess[inside]
        if not len(g):
            return where
        whole = g.sum() ** 2 / (h.sum() + ridge)
        for j in range(b.shape[1]):
            gl, hl = (np.cumsum(np.bincount(b[:, j], v, 65))[:-1] for v in (g, h))
            gr, hr = g.sum() - gl, h.sum() - hl
            gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole, -1)
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = gain[k], (j, k)
        return where

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins, f, rows = self._bins(x), np.full(len(x), self.base), np.arange(len(x))
        for splits, leaf in self.trees:
            node = np.zeros(len(x), int)
            for found in splits:
                feature, cut = np.array(found).T
                node = 2 * node + (bins[rows, feature[node]] > cut[node])
            f += leaf[node]
        return f


class Isotonic:
    """The non-decreasing function of the margin nearest to the labels, linear between its steps' middles."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []  # weight, sum of labels, sum of margins
        for m, v in zip(margin[order], y[order]):
            pools.append([1.0, v, m])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                top = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], top)]
        w, s, m = np.array(pools).T
        self.x, self.y = m / w, (s + 0.01) / (w + 0.02)
        self.y = np.maximum.accumulate(self.y)

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.y)


def fit(docs: DataFrame, labels: DataFrame, teaches: Column, label: str = "toxic") -> tuple:
    """(lexicon, trees, isotonic) or, without both labels, (rate,). teaches: which rows of labels may teach."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & teaches).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).withColumn("part", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)))
    # Of rows that share a doc_id the smallest text teaches.
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "y", "part").agg(F.min("text").alias("text")))
    lexicon = learn_lexicon(rows.where("part < 2").select("text", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features_of(t, lexicon) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "part", "y", "x"])

    taught = rows.where("part >= 2").mapInArrow(run, "doc_id bigint, part bigint, y int, x array<double>").collect()
    taught.sort(key=lambda r: r["doc_id"])
    part, y = np.array([r["part"] for r in taught]), np.array([r["y"] for r in taught], float)
    if len(set(y[part < 4])) < 2 or len(set(y[part == 4])) < 2:
        return (float(y.mean()) if len(y) else 0.0,)
    x = np.array([r["x"] for r in taught])
    trees = Trees(x[part < 4], y[part < 4])
    return lexicon, trees, Isotonic(trees.margin(x[part == 4]), y[part == 4])


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, score) of every row of `docs`."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(model) == 1 or not b.num_rows:
                s = np.full(b.num_rows, model[0] if len(model) == 1 else 0.0)
            else:
                x = np.array([features_of(t, model[0]) for t in b.column("text").to_pylist()])
                s = np.round(np.clip(model[2](model[1].margin(x)), 0, 1), 6)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
