"""Near-duplicates: every pair of candidates is decided by its sets of shingles."""

import random

from tessera.llm import simhash

DOCS = "doc_id long, text string"


def found(spark, texts):
    out = simhash.similar_components(spark.createDataFrame(list(enumerate(texts)), DOCS))
    return [r["component_id"] for r in out.orderBy("doc_id").collect()]


def own(name, n):
    return [f"{name}x{j}" for j in range(n)]


def test_every_pair_of_a_large_group_of_like_texts_is_decided(spark, monkeypatch):
    # Any two texts have a similarity of 0.76, which is under 0.8 but near; texts 2 i and 2 i + 1 have 0.81.
    monkeypatch.setattr(simhash, "TILE_ROWS", 30)
    texts = [" ".join(own("t", 308) + own(f"p{i // 2}", 12) + own(f"o{i}", 36)) for i in range(200)]
    assert found(spark, texts) == [i - i % 2 for i in range(200)]


def test_repeats_of_a_passage_count_once(spark):
    passage = own("r", 104)
    texts = [" ".join(passage * 10 + own(f"a{i}", 200)) for i in range(2)]  # alike in the passage only
    phrase = own("q", 5)
    texts += [" ".join(phrase * 300 + own(f"b{i}", 300)) for i in range(2)]  # over half of all shingles are the phrase's
    plain = own("s", 400)
    texts += [" ".join(plain), " ".join(plain[:210] + plain[200:210] * 60 + plain[210:])]  # alike but for repeats
    assert found(spark, texts) == [0, 1, 2, 3, 4, 4]


def test_hot_cells_are_dealt_into_parts(spark, monkeypatch):
    r = random.Random(12)
    texts = []
    for g in range(12):
        words = own(f"g{g}", 60) + own("shared", 60)  # all meet in cells of the shared words
        for _ in range(8):
            w = list(words)
            for _ in range(r.randint(0, 3)):
                w[r.randint(0, 59)] = f"x{r.randint(0, 999)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    whole = simhash.simhash_components(docs).orderBy("doc_id").collect()
    similar = found(spark, texts)
    monkeypatch.setattr(simhash, "CELL_ROWS", 5)
    monkeypatch.setattr(simhash, "FEW_ROWS", 3)
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 16)
    assert simhash.simhash_components(docs).orderBy("doc_id").collect() == whole
    assert found(spark, texts) == similar
    sets = [{tuple(t.split()[j : j + 5]) for j in range(116)} for t in texts]
    for i in range(len(texts)):  # every pair of 0.8 or more is in one group
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                assert similar[i] == similar[j]
