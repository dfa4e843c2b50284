"""The vectorised pass over texts against the plain definitions of words, terms and stems."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import analysis, wordscan
from tessera.operators import search
from tessera.plans.registry import QUERIES

ODD = [
    "The dog's U.S.A. can't 1,000 a x_y é hello-world", "", "the of a", None, "x's 's ’s a’s. _ __ ._. a._b 3.14.15 1,a a,1 b.1 a:b a: :b", "İstanbul ΟΔΟΣ ΣΑΣ İ Σ K Å",
    "ends in the", "naïve café 日本語 テスト 한국어 \U00010400x \U0001f600 y", "a\nb\r\nccc\x00dd\x85ee's\n", "o'clock's it's IT'S dogs' rock'n'roll", "x" * 300 + " tail the a",
]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice("abS s's''’.:,,_ 19éΣ\n-the ") for _ in range(rng.randrange(120))) for _ in range(120)]
    return ODD + made


def test_words_as_defined(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_ref int, text string")
    want = [[(t["pos"], t["term"]) for t in r["w"] or []] for r in rows.orderBy("doc_ref").select(analysis.words(F.col("text")).alias("w")).collect()]
    words = wordscan.Words([t or "" for t in texts()])
    at, terms = words.remaining()
    got = [[] for _ in want]
    for d, p, t in zip(words.text_of[at].tolist(), words.place[at].tolist(), terms.to_pylist()):
        got[d].append((p, t))
    assert got == want
    assert words.lengths() == [w[-1][0] + 1 if w else None for w in want]
    for term in ["dog", "usa", "é", "the", "οδος", "σας", "i̇stanbul", "x" * 300, "ab", "19"]:
        if term not in analysis.STOPWORDS:
            assert words.find(term).tolist() == [w for w in at.tolist() if words._term(w) == term]
    stems = words.find_stems(["dog", "clock", "ab", "日本語"])
    for s, found in stems.items():
        assert found.tolist() == [w for w, t in zip(at.tolist(), terms.to_pylist()) if analysis.porter(t) == s]


def test_stems_begin_as_their_words():
    rng = random.Random(3)
    ends = ["s", "sses", "ies", "eed", "ed", "ing", "y", "e", "ll", *analysis.STEP2, *analysis.STEP3, *analysis.STEP4]
    for _ in range(20_000):
        word = "".join(rng.choice("abcesty") for _ in range(rng.randrange(5))) + rng.choice(ends) + rng.choice(["", *ends])
        stem = analysis.porter(word)
        assert stem[:1] == word[:1] and len(stem) <= len(word)


def test_groups_keep_every_text(monkeypatch):
    monkeypatch.setattr(wordscan, "GROUP", 5)
    column = pa.array(["abc", None, "def", "toolong", "", "x"])
    assert [(i, g) for i, g in wordscan.groups(column)] == [(0, ["abc", ""]), (2, ["def"]), (3, ["toolong"]), (4, ["", "x"])]


def test_postings_as_counted(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_ref int, text string")
    for stem in (False, True):
        want = {}
        for r in rows.select("doc_ref", analysis.words(F.col("text")).alias("w")).collect():
            for t in r["w"] or []:
                want.setdefault((analysis.porter(t["term"]) if stem else t["term"], r["doc_ref"], r["w"][-1]["pos"] + 1), []).append(t["pos"])
        posts = search.postings(rows, stem).collect()
        assert {(r["term"], r["doc_ref"], r["dl"]): r["positions"] for r in posts} == want and len(posts) == len(want)
        assert all(r["tf"] == len(r["positions"]) for r in posts)
    assert "positions" not in search.postings(rows, places=False).columns


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")


def test_postings_are_made_without_a_shuffle(spark):
    rows = spark.createDataFrame([("a", "red blue red")], "doc_ref string, text string")
    assert exchanges(search.postings(rows)) == 0


def test_queries_share_one_pass(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "red blue red", 0), ("b", "blue", 1), ("c", "", 1), ("d", "red", 1)], "doc_ref string, text string, t int")
    passes = []
    monkeypatch.setattr(search, "cut", lambda df: passes.append(1) or df)
    each = search.bm25_each(rows, ["red", "blue", "the", "red"], 5, within=[F.lit(True), F.lit(True), F.lit(True), F.col("t") < 1])
    assert len(passes) == 1
    got = [[r.asDict() for r in df.collect()] for df in each]
    for df, (q, part) in zip(got, [("red", rows), ("blue", rows), ("the", rows), ("red", rows.where("t < 1"))]):
        assert df == [r.asDict() for r in search.bm25(part, q, 5).collect()]
    assert [len(x) for x in got] == [2, 2, 0, 1]


def test_phrase_query_ranks_the_best_plain_hits_among_all(spark, tmp_path):
    """The ten of highest plain score; hits with the phrase outrank them, which shows in their ranks."""
    rows = [(i, "ther from" + " filler" * 10) for i in range(20)] + [(i, "from " * (1 + i % 3) + "ther filler") for i in range(20, 35)]
    rows += [(i, "other words") for i in range(35, 120)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    from tessera.plans.registry import ORACLE_SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["bm25_phrase"]).fetchall())
    got = sorted((r["doc_ref"], r["score"], r["rank"]) for r in QUERIES["bm25_phrase"](spark, str(tmp_path)).collect())
    assert got == [(d, round(s, 6), r) for d, s, r in want] and max(r for *_, r in got) > 10


def test_texts_of_any_length(spark):
    words = wordscan.Words(["", "word " * 300_000, ""])
    assert words.lengths() == [None, 300_000, None] and len(words.find("word")) == 300_000
    assert len(wordscan.Words([])) == 0 and wordscan.Words([]).lengths() == [] and np.array_equal(wordscan.Words(["", ""]).remaining()[0], [])
