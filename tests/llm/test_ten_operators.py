"""The ten operators on small tables: brute force, round trips, and odd rows.

The odd rows, for each of them: nulls in any column, empty and very long texts, ties and repeated
rows, an empty table, further columns with names that clash.
"""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import AddedToken, Tokenizer

from tessera.llm import knn, lines, mixing, pieces, quality_rules, simhash, site_quality, text, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCS)


def prose(n=80, seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéfgü") for _ in range(r.randint(2, 8))) for _ in range(120)]
    rows = []
    for i in range(n):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 30))) + r.choice(["", ".", "!"]) for _ in range(r.randint(1, 6))]
        rows.append([i, "\n".join(parts), r.choice(["en", "fr"]), f"s{r.randint(0, 3)}"])
    for i in range(0, n, 9):
        rows[i][1] = rows[(i + 4) % n][1]
    rows[5][1] = rows[6][1] + "\n" + rows[7][1]
    return [tuple(x) for x in rows]


ODD = [
    (1000, None, "en", "s0"), (1001, "", None, None), (1002, "  \n\t ", "en", None), (None, "a text without an id", None, "s1"), (1003, "word " * 40_000, "fr", "s2"),
    (1004, "x" * 200_000, "fr", "s2"), (1005, "repeated row", "en", "s0"), (1005, "repeated row", "en", "s0"), (1006, "▁ odd  \x0b 日本 🙂 \x00 end ", "ja", "s3"),
    (-7, "Negative id", "en", "s0"),
]
ROWS = prose() + ODD


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark, ROWS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """With columns of the names that operators use inside or return."""
    names = "size copies target line key pos h n_lines pieces words score rank cell evidence kept node component_id f0 taken digest first"
    return df.select("*", *(F.lit("other").alias(n) for n in names.split() if n not in df.columns))


# 1


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(spark, table, empty):
    mixed = mixing.mix(clashing(table), text.n_words("text"))
    rows = mixed.collect()
    assert len(rows) == len(ROWS)
    sizes = defaultdict(int)
    for _, t, _, s in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = water(sizes), defaultdict(int)
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        largest = max((len(WORD.findall(t or "")) for _, t, _, x in ROWS if x == s), default=0)
        assert abs(taken[s] - want[s]) <= 2 * largest + 1
    again = mixing.mix(clashing(table.repartition(3)), text.n_words("text")).collect()
    key = lambda rs: sorted((r["doc_id"] or -1, r["source"] or "", r["copies"]) for r in rs)
    assert key(again) == key(rows)
    assert mixing.emit(mixed, table.columns).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty, text.n_words("text")).count() == 0


def test_mixing_is_near_its_targets(spark):
    r = random.Random(1)
    rows = [(i, r.randint(1, 400), "abc"[min(2, r.randint(0, 5))]) for i in range(6000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, w long, source string"), F.col("w"))
    for g in out.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert g["taken"] == pytest.approx(g["target"], rel=0.01)


# 2


def base(t):
    ws = WORD.findall(t or "")
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    twice = Counter(windows)
    covered = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 8)}
    ls = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum((t or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered)


def test_base_statistics(spark, table, empty):
    more = docs(spark, [(1, "a b c d e f g h " * 3 + "tail | x # y", "en", "s"), (2, "l one\nl one\n\n\nl two\nl one", "en", "s")])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for df in (clashing(table), more):
        for r in quality_rules.base_statistics(df).collect():
            assert tuple(r[n] for n in names) == base(r["text"])
    assert quality_rules.base_statistics(empty).count() == 0
    assert quality_rules.reject_outliers(empty).count() == 0


def test_outliers_are_rejected(spark):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(500):
        words = [r.choice(vocab) for _ in range(r.randint(30, 120))]
        if i % 10 == 0:
            words = [w + "$%&"[r.randint(0, 2)] * 2 for w in words]
        rows.append((i, " ".join(words), "en", "one"))
    found = {x["doc_id"]: x for x in quality_rules.reject_outliers(docs(spark, rows)).collect()}
    assert {i for i in range(500) if not found[i]["kept"]} == set(range(0, 500, 10))


def test_outliers_odd_rows(table):
    rows = quality_rules.reject_outliers(clashing(table)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and (r["distance"] is None) == r["base_failed"]


# 3


def best_of(rows, k=5):
    """By whole numbers: {query: [(rank, vec_id, score)]} of (vec_id, vector)."""
    whole = [(i, [floor(float(x) * 256) for x in v]) for i, v in rows]
    found = {}
    for q, a in whole:
        if q % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))
            found[q] = [(n + 1, i, -t) for n, (t, i) in enumerate(s[:k])]
    return {q: f for q, f in found.items() if f}


def answers(df, **how):
    found = defaultdict(list)
    for r in knn.exact_top_k(df, F.col("vec_id") % 50 == 0, k=5, **how).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return found


VECTORS = "vec_id long, embedding array<float>, label int"


def test_knn(spark):
    g = np.random.default_rng(2)
    rows = [(i, [float(np.float32(v)) for v in g.normal(size=6) * (1 + i % 3)], 1) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(300)] + [(2000 + i, [0.0] * 6, 0) for i in range(30)]
    rows += [(3200, [1.0, 2.0], 0), (3201, [5000.0, 1.0], 0), (3250, [], 0), (3251, [], 0)]
    odd = [(3000, None, 0), (3050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (3100, [float("nan")] * 6, 0), (3150, [float("inf")] * 6, 0), (None, [9.0] * 6, 0)]
    df = spark.createDataFrame(rows + odd, VECTORS).withColumn("cell", F.lit("x")).withColumn("v", F.lit(1)).withColumn("dim", F.lit(1))
    assert answers(df, pivots=8) == best_of([r[:2] for r in rows])
    assert knn.exact_top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = df.where("vec_id IN (0, 1)")
    assert [r["vec_id"] for r in knn.exact_top_k(few, F.col("vec_id") % 50 == 0).collect()] == [1]


def test_knn_of_large_components(spark):
    g = np.random.default_rng(5)
    near = [float(np.float32(v)) for v in g.normal(size=6) * 1e6]
    rows = [(i, [float(np.float32(v)) for v in g.normal(size=6) * 10.0 ** (i % 7)]) for i in range(300)]
    # Differences that a double's product does not show.
    rows += [(400 + i, [near[0], *near[1:5], near[5] + 0.125 * i]) for i in range(60)]
    got = answers(spark.createDataFrame([(*r, 0) for r in rows], VECTORS.replace("float", "double")), pivots=8)
    assert got == best_of(rows)
    rows = [(50, [5000.0, 1.0]), (3, [5000.0, 2.0]), (100, [1e30, 1.0]), (4, [-1e30, 3.0]), (5, [2e30, 0.0]), (6, [1.0, 1e-3])]
    most = (1 << 63) - 1
    want = {q: [(n, i, min(max(s, -most - 1), most)) for n, i, s in f] for q, f in best_of([(i, np.float32(v)) for i, v in rows]).items()}
    assert answers(spark.createDataFrame([(*r, 0) for r in rows], VECTORS)) == want
    assert want[100][0] == (1, 5, most) and want[100][-1][1] == 4


# 4

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_library():
    r = random.Random(4)
    bits = [" ", "  ", "\n", "\t", "a", "The", "don't", "é", "1", "99", "!", "...", "日本", "🙂", "<|endoftext|>", " ", " ", "\x1c", "_", "²", "Ⅷ", "é", "'s", " \n "]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(4000)] + ["x" * 50_000, None, ""]
    e = tokens.Encoder(BPE)
    want = Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)
    for t, got, w in zip(texts, e.encode(texts), want):
        assert got.tolist() == w.ids, t
    assert any(50256 in w.ids for w in want)


def test_encoder_with_other_added_tokens(tmp_path):
    t = Tokenizer.from_file(BPE)
    t.add_tokens([AddedToken("dog", single_word=True), AddedToken("<x>", lstrip=True), "<x><y>"])
    t.save(str(tmp_path / "t.json"))
    texts = ["a dog, dogs", " <x>  b", "<x><y> c <|endoftext|>", "no such", None]
    fresh = Tokenizer.from_file(str(tmp_path / "t.json"))
    assert [x.tolist() for x in tokens.Encoder(str(tmp_path / "t.json")).encode(texts)] == [fresh.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_token_files(spark, table, empty, tmp_path):
    manifest = tokens.write_tokens(clashing(table), str(tmp_path / "t"), BPE, end=2)
    back = tokens.read_tokens(manifest).collect()
    crc = {(r["doc_id"], r["start"]): r for r in tokens.read_digests(manifest).collect()}
    e = tokens.Encoder(BPE)
    place = 0
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    back.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in back] == [r[0] for r in rows]
    for r, (_, t, _, _) in zip(back, rows):
        ids = e.encode([t])[0].tolist() + [2]
        assert r["ids"] == ids and r["start"] == place and r["n_tokens"] == len(ids)
        assert crc[(r["doc_id"], r["start"])]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        place += len(ids)
    one = tokens.TokenFile(manifest.where("n_docs > 3").first()["file"])
    assert one.ids(2)[-1] == 2 and one.f.read_at(4, 0) == b"TKID"
    assert tokens.read_tokens(tokens.write_tokens(empty, str(tmp_path / "e"), BPE, end=2)).count() == 0


def test_dictionary_serves_short_documents(spark, tmp_path):
    df = docs(spark, [(i, f"the same short words again and again {i % 17} of {i % 5}", "en", "s") for i in range(800)])
    manifest = tokens.write_tokens(df, str(tmp_path / "d"), BPE, end=2)
    assert list((tmp_path / "d").glob("*.dictionary"))
    assert tokens.read_tokens(manifest).count() == 800


# 5


def test_warc(spark, tmp_path):
    big, r = "<p>" + "é" * 60 + "</p>", random.Random(1)
    rows = [(5, "http://a/x", big), (3, "http://a/y\r\nWARC-Type: bad", big), (9, None, big), (3, "http://a/y", big), (None, "u", big), (7, "v", None), (8, "w", ""), (10, "x", "small"), (11, "x", "small")]
    rows += [(20 + i, f"http://b/{i}", "".join(r.choice("ab\r\n<>") for _ in range(300))) for i in range(40)] + [(100, "l", "z" * 400_000), (99, "l", "z" * 400_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2)).repartition(3)
    files = warc.write_warc(df, str(tmp_path / "w"))
    caps = warc.assemble(warc.read_warc(files)).collect()
    assert len(caps) == len(rows)
    got = Counter()
    for c in caps:
        f = c["metadata"]["fields"]
        assert c["request"]["kind"] == "request"
        got[(f["pageId"], c["response"]["kind"], c["response"]["payload_digest"], c["response"]["payload_bytes"] if c["response"]["kind"] == "response" else int(f["payloadLength"]), f.get("refersToPage"), c["response"]["refers_to"])] += 1
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((x for x, _, y in rows if y == h and x is not None), default=None)
        again = len(b) >= 100 and i is not None and i > first
        want[("" if i is None else str(i), "revisit" if again else "response", hashlib.sha256(b).hexdigest(), len(b), str(first) if again else None)] += 1
    assert Counter(x[:-1] for x in got.elements()) == want
    # A revisit names a written response with its payload, but where two rows have the smallest page.
    answers = {c["response"]["record_id"]: c["response"] for c in caps}
    for c in caps:
        if c["response"]["kind"] == "revisit" and c["metadata"]["fields"]["refersToPage"] != "3":
            to = answers[c["response"]["refers_to"]]
            assert to["kind"] == "response" and to["payload_digest"] == c["response"]["payload_digest"]
    assert {c["response"]["refers_to"] is None for c in caps if c["metadata"]["fields"].get("refersToPage") == "3"} == {True}
    plain = tmp_path / "plain.warc"
    plain.write_bytes(b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.warc.gz"))))
    assert warc.read_warc(warc.archives(spark, str(plain)), with_payload=False).count() == 3 * len(rows)
    none = warc.write_warc(df.where("false"), str(tmp_path / "none"))
    assert warc.assemble(warc.read_warc(none)).count() == 0


def test_assembly_of_broken_captures(spark):
    rec = lambda i, k, to: (i, k, to, None, 1, "d", None, {}, None)
    rows = [rec("a", "response", None), rec("q2", "request", "a"), rec("q1", "request", "a"), rec("m", "metadata", "a"), rec("lost", "metadata", "nowhere"), rec("r", "request", None), rec("b", "revisit", None)]
    caps = {c["capture_id"]: c for c in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert set(caps) == {"a", "b"} and caps["a"]["request"]["record_id"] == "q1" and caps["a"]["metadata"]["record_id"] == "m" and caps["b"]["metadata"] is None


# 6


def toxic_rows(n=1500):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(20, 90))]
        bad = r.random() < 0.25
        if bad:
            for _ in range(r.randint(2, 5)):
                words.insert(r.randint(0, len(words)), r.choice(["zzfool", "zzidiot", "zzclown"]))
        rows.append((10_000 + i, " ".join(words), "en", "s"))
        labels.append((10_000 + i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark, table):
    rows, labels = toxic_rows()
    lab = spark.createDataFrame(labels + [(None, 1, 1), (50_000, 1, None), (10_003, 1, 7)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows + ODD)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(clashing(df), lab, ~held)
    assert {"zzfool", "zzidiot", "zzclown"} <= set(model[0])
    out = toxicity.score(clashing(df), model).collect()
    assert len(out) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    truth = {i: y for i, _, y in labels}
    wrong = sum((r["score"] >= 0.5) != truth[r["doc_id"]] for r in out if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert wrong <= 5
    same = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.fit(df.repartition(3), lab, ~held)).collect()}
    assert all(same[r["doc_id"]] == r["score"] for r in out if r["doc_id"] is not None)
    lone = toxicity.fit(df, lab.where("toxic = 0"), F.lit(True))
    assert {r["score"] for r in toxicity.score(df, lone).collect()} == {0.0}
    assert toxicity.score(df.where("false"), model).count() == 0


def test_isotonic_rises():
    m, y = np.random.default_rng(1).normal(size=(2, 500))
    f = toxicity.Isotonic(m, (y + m > 0).astype(float))
    assert (np.diff(f(np.linspace(-5, 5, 200))) >= 0).all()


# 7

SP = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_round_trip(spark, table, empty):
    coded = pieces.encode(clashing(table).withColumnRenamed("n_chars", "text_2"), SP)
    rows = pieces.decode(coded, SP).collect()
    want = Counter((i, t or "") for i, t, _, _ in ROWS)
    assert Counter((r["doc_id"], r["text"]) for r in rows) == want
    once = pieces.encode_and_decode(clashing(table), SP).select("doc_id", "text", F.xxhash64("pieces").alias("p")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in once) == want
    again = pieces.encode(table.repartition(2), SP).select("doc_id", F.xxhash64("pieces").alias("p")).collect()
    assert sorted((r["doc_id"] or -1, r["p"]) for r in again) == sorted((r["doc_id"] or -1, r["p"]) for r in coded.select("doc_id", F.xxhash64("pieces").alias("p")).collect())
    other = pieces.encode(table, SP, seed=12).select(F.sum(F.xxhash64("pieces").cast("decimal(38,0)"))).first()[0]
    assert other != coded.select(F.sum(F.xxhash64("pieces").cast("decimal(38,0)"))).first()[0]
    assert pieces.decode(pieces.encode(empty, SP), SP).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,)], "pieces array<int>"), SP).first()["text"] is None


def test_sampling_follows_the_lattice():
    lat = pieces.Lattices(SP, 1.0)

    def paths(t):
        if not t:
            return [((), 0.0)]
        return [((lat.pieces[t[:j]][0], *rest), lat.pieces[t[:j]][1] + w) for j in range(1, len(t) + 1) if t[:j] in lat.pieces for rest, w in paths(t[j:])]

    every = paths("▁there")
    total = sum(np.exp(w) for _, w in every)
    n = 60_000
    seen = Counter(tuple(x.tolist()) for x in lat.encode(["there"] * n, list(range(n)), 1))
    assert set(seen) <= {p for p, _ in every}
    for p, w in every:
        assert abs(seen[p] / n - np.exp(w) / total) < 0.01


# 8


def test_lines(spark, table, empty):
    rows = ROWS + [(2000, "Shared line here\nown", "en", "s"), (2001, "  SHARED LINE HERE\t\nshared line here\nshort\n", "en", "s"), (2002, "short\nshared line here", None, None)]
    df = clashing(docs(spark, rows).repartition(4))
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for least in (2, 3):
        own = defaultdict(set)
        for i, t, _, _ in rows:
            for s in (t or "").split("\n"):
                if i is not None and len(key(s)) >= 10:
                    own[key(s)].add(i)
        want = Counter()
        for i, t, _, _ in rows:
            ls = (t or "").split("\n")
            kept = [s for s in ls if i is None or not (len(own[key(s)]) >= least and min(own[key(s)]) != i)]
            want[(i, len(ls), len(ls) - len(kept), "\n".join(kept))] += 1
        got = lines.dedup_lines(df, 10, least)
        assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == want
        assert {"doc_id", "text", "lang", "source", "key", "pos"} <= set(got.columns)
    assert lines.dedup_lines(empty).count() == 0


# 9


def test_site_quality(spark, table, empty):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        body = [r.choice(["tree", "house", "river", "stone", "cloud", "meadow"]) + str(r.randint(0, 99) if bad else "") for _ in range(60)]
        rows.append((i, " | ".join(body) if bad else " ".join(body) + ".", "en", f"s{i % 4}"))
        labels.append((i, int(not bad), 0))
    lab = spark.createDataFrame(labels[:600] + [(None, 1, 0), (700, None, 0), (701, 5, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    out = {x["doc_id"]: x for x in site_quality.classify(clashing(df), lab).collect()}
    assert all(out[i]["kept"] == (i % 6 != 0) for i in range(900))
    # The posterior by numpy.
    p = np.array([np.floor(1e6 / (1 + np.exp(-out[i]["evidence"])) + 0.5) for i in range(900)]) / 1e6
    assert all(0 < out[i]["site_rate"] < 1 for i in range(900))
    by = {s: p[s::4] for s in range(4)}
    assert all(min(v.mean() for v in by.values()) - 0.05 <= out[i]["site_rate"] <= max(v.mean() for v in by.values()) + 0.05 for i in range(900))
    good = site_quality.keep_good(df, lab)
    assert good.count() == 750 and good.columns == df.columns
    assert site_quality.classify(clashing(table), lab).count() == len(ROWS)
    assert site_quality.keep_good(table, lab.where("false")).count() == len(ROWS)
    assert site_quality.classify(empty, lab).count() == 0


def test_sparse_sites_shrink(spark):
    lab = spark.createDataFrame([(i, int(i % 2)) for i in range(200)], "doc_id long, quality int")
    rows = [(i, "plain words in a row " * 3 if i % 2 else "# $ % | & < > * #", "en", "big" if i < 190 else f"tiny{i}") for i in range(200)]
    out = {x["doc_id"]: x["site_rate"] for x in site_quality.classify(docs(spark, rows), lab).collect()}
    assert abs(out[195] - 0.5) < 0.2 and abs(out[0] - 0.5) < 0.1


# 10


def fingerprint(t, k):
    w = WORD.findall((t or "").translate(LOWER))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, radius):
    parent = {i: i for i in range(len(ids))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                parent[root(a)] = root(b)
    low = defaultdict(lambda: 1 << 62)
    for i, d in enumerate(ids):
        low[root(i)] = min(low[root(i)], d)
    return [low[root(i)] for i in range(len(ids))]


def test_simhash(spark, empty):
    r = random.Random(6)
    rows = [x for x in ROWS if x[0] != 1003 and x[0] != 1004]
    for i in range(60):
        w = rows[20 + i % 10][1].split(" ")
        w[r.randint(0, len(w) - 1)] = f"w{r.randint(0, 2)}"
        rows.append((3000 + i, " ".join(w), "en", "s"))
    df = clashing(docs(spark, rows).repartition(4))
    withid = [x for x in rows if x[0] is not None]
    fps = [fingerprint(t, 3) for _, t, _, _ in withid]
    want = Counter((i, f"{f:016x}", c) for (i, *_), f, c in zip(withid, fps, components([x[0] for x in withid], fps, 2)))
    for blocks in (4, 8):
        out = simhash.simhash_components(df, k=3, words=1, radius=2, blocks=blocks)
        got = Counter((x["doc_id"], x["f"], x["component_id"]) for x in out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("f"), "component_id").collect())
        assert {k: v for k, v in got.items() if k[0] is not None} == want
        assert [k[2] for k in got if k[0] is None] == [None]
    grid = simhash.simhash_components(df, k=3, words=1, radius=9)
    far = components([x[0] for x in withid], fps, 9)
    assert {x["doc_id"]: x["component_id"] for x in grid.collect() if x["doc_id"] is not None} == {i: c for (i, *_), c in zip(withid, far)}
    assert simhash.simhash_components(empty).count() == 0


def test_one_of_each_stays(spark):
    r = random.Random(9)
    text_ = lambda: " ".join(f"w{r.randint(0, 3000)}" for _ in range(200))
    rows = [(i, text_(), "en", "s") for i in range(30)]
    rows += [(100 + i, rows[3][1], "en", "s") for i in range(20)]
    for i in range(20):
        w = rows[5][1].split()
        w[r.randint(0, 199)] = "changed"
        rows.append((200 + i, " ".join(w), "en", "s"))
    rows += [(300, None, "en", "s"), (301, "", "en", "s"), (None, rows[3][1], None, None), (4, rows[4][1], "en", "s")]
    kept = simhash.keep_one_of_each(clashing(docs(spark, rows)))
    assert sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == [*range(30), 300]
    assert kept.where("doc_id IS NULL").count() == 1


def test_similar_documents_are_decided_exactly(spark):
    r = random.Random(21)
    rows, sets = [], {}
    for g in range(25):
        words = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(30, 250))]
        for c in range(4):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randint(0, len(w) - 1)] = f"x{r.randint(0, 99)}"
            i = len(rows)
            rows.append((i, " ".join(w), "en", "s"))
            sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    pairs = [(a, b) for a in sets for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    out = simhash.similar_components(docs(spark, rows).repartition(3))
    assert {x["doc_id"]: x["component_id"] for x in out.collect()} == {i: root(i) for i in range(len(rows))}
    assert 25 < len({root(i) for i in range(len(rows))}) < 100


def test_types_of_results(spark):
    assert simhash.simhash_components(docs(spark, ROWS[:5])).schema["component_id"].dataType == T.LongType()
