"""The pipeline over a small folder of tables: stages, plants, odd rows."""

import random

import pytest

import corpus_pipeline
from tessera.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(800)]
    sentence = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(12, 25))) + "."
    rows = [(i, "\n".join(sentence() for _ in range(6)), "en", f"s{i % 3}") for i in range(150)]
    rows += [(200 + i, " | ".join(r.choice(vocab) + "$%" for _ in range(60)), "en", f"s{i % 3}") for i in range(30)]
    rows += [(300 + i, rows[i][1], "en", "s1") for i in range(5)]
    for i in range(5):
        w = rows[20 + i][1].split(" ")
        w[40] = "altered"
        rows.append((320 + i, " ".join(w), "en", "s1"))
    rows += [(400, None, None, None), (401, "", "en", None), (None, sentence(), "en", "s0"), (402, "word " * 30_000, "en", "s2"), (10, rows[10][1], "en", "s1")]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(150)] + [(200 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        seen[name] = [r["doc_id"] for r in out.collect()]
        if name != "pieces":
            assert out.columns == docs.columns
            docs = out
    assert set(range(150)) <= set(seen["quality"]) and not set(range(200, 230)) & set(seen["quality"])
    assert sorted(map(str, seen["lines"])) == sorted(map(str, seen["quality"]))
    # What line dedup leaves of exact copies are empty texts, one of which stays; of near copies, their own lines.
    assert set(range(150)) - set(range(5)) <= set(seen["simhash"]) and not set(range(301, 305)) & set(seen["simhash"]) and seen["simhash"].count(10) == 1
    assert set(seen["mixing"]) <= set(seen["simhash"]) and sorted(map(str, seen["pieces"])) == sorted(map(str, seen["mixing"]))


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "n_pieces", "pieces_hash"} <= set(out.columns) and out.count() > 100


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert [n for n in entry.queries() if n.startswith("op")] == list(queries.QUERIES) and len(queries.QUERIES) == 10
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
