"""Sharding, near duplicates, nearest neighbours, packing and the pipeline against plain versions."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_cases import EDGE, NEAR, components, edge, empty, quality, shingles

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


# sharding

def test_hypergeometric_draws(spark):
    from sensortracks.llm.sharding import hypergeometric

    total, marked, drawn, n = 30, 12, 9, 20_000
    lit = lambda x: F.lit(x).cast("long")
    got = spark.range(n).select(hypergeometric(lit(total), lit(marked), lit(drawn), (F.col("id") + 0.5) / n).alias("x"))
    seen = Counter(r["x"] for r in got.collect())
    for x in range(drawn + 1):
        p = math.comb(marked, x) * math.comb(total - marked, drawn - x) / math.comb(total, drawn)
        assert abs(seen[x] / n - p) < 2 / n  # the u are even, so counts are the probabilities
    for a, b, c in ((10, 0, 4), (10, 10, 4), (10, 3, 10), (10, 3, 0), (1_000_000, 300_000, 500_000)):
        x = spark.range(1).select(hypergeometric(lit(a), lit(b), lit(c), F.lit(0.5))).first()[0]
        assert max(0, b + c - a) <= x <= min(b, c) and abs(x - b * c / a) <= max(1, 0.01 * b)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_matrix_sums(spark, parts):
    from sensortracks.llm.sharding import communication_matrix

    rng = random.Random(parts)
    sizes = [rng.randint(1, 400) for _ in range(parts)]
    counts = spark.createDataFrame(list(enumerate(sizes)), "node long, n long")
    rows = communication_matrix(counts, 8, 11).collect()
    assert {r["node"]: sum(r["vec"]) for r in rows} == dict(enumerate(sizes))
    whole = np.array([r["vec"] for r in rows]).sum(0)
    assert whole.sum() == sum(sizes) and whole.max() - whole.min() <= 1


def test_shards_are_exact_and_uniform(spark):
    from sensortracks.llm.sharding import shard_rows

    df = spark.range(4001).withColumn("shard", F.lit("old"))
    places = []
    for seed in (1, 2):
        out = shard_rows(df.repartition(3), 8, seed).toPandas()
        assert sorted(out["id"]) == list(range(4001))
        assert sorted(out.groupby("shard").size()) == [500] * 7 + [501]
        assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard")["slot"])
        assert abs(out["id"].corr(out["slot"])) < 0.06 and abs(out["id"].corr(out["shard"])) < 0.06
        places.append(out.sort_values("id")["shard"].tolist())
    same = np.mean(np.array(places[0]) == np.array(places[1]))
    assert 0.08 < same < 0.17
    got = shard_rows(edge(spark), 8).toPandas()
    assert len(got) == len(EDGE) and got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 1
    assert shard_rows(empty(spark), 8).count() == 0


# near duplicates

def test_shingle_sets():
    from sensortracks.llm.neardup import shingle_sets, signatures

    texts = [r[1] for r in EDGE] + ["a b c d e", "a b c d e a b c d e", "a", "b a", "a b", "A\x0bB"]
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for i, s in enumerate(texts):
        for j, t in enumerate(texts):
            assert (set(sets[i]) == set(sets[j])) == (shingles(s) == shingles(t))
    a, b = (shingle_sets([" ".join(f"w{i}" for i in range(x, x + 400))])[0] for x in (0, 60))
    sa, sb = signatures([a, b])
    assert abs((sa == sb).mean() - len(set(a) & set(b)) / len(set(a) | set(b))) < 0.2


def test_components_equal_brute_force(spark):
    from sensortracks.llm.neardup import near_duplicates

    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    for i in range(60):  # a group of near copies, each with a change of its own
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        docs.append((10_000 + i, " ".join(w)))
    chain = [f"v{i}" for i in range(400)]
    docs += [(20_000 + i, " ".join(chain[10 * i:10 * i + 130])) for i in range(20)]  # each like the next only
    docs += [r[:2] for r in EDGE]
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    want = Counter((d, len(shingles(t)), c if shingles(t) else d) for (d, t), c in zip(docs, components(docs), strict=True))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == want
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in rows)


@pytest.mark.parametrize("added", [True, False])
def test_copies_that_link_to_their_template_only(spark, added):
    from sensortracks.llm.neardup import near_duplicates

    base = [f"w{i}" for i in range(104)]
    docs = [(1, " ".join(base))]
    for i in range(5000):  # 20 words of its own at the end, or one changed word in each of two places
        own = base + [f"x{i}y{j}" for j in range(20)] if added else list(base)
        if not added:
            a, b = 6 + i % 41, 55 + i % 43
            own[a], own[b] = f"x{i}", f"y{i}"
        docs.append((100 + i, " ".join(own)))
    docs += [(9_000 + i, " ".join(f"z{i}v{j}" for j in range(90))) for i in range(9)]
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {d: 1 if d < 9_000 else d for d, _ in docs}
    assert sum(r["kept"] for r in rows) == 10


def test_neardup_edges(spark):
    from sensortracks.llm.neardup import deduplicated, near_duplicates

    assert near_duplicates(empty(spark)).count() == 0 and deduplicated(empty(spark)).count() == 0
    out = deduplicated(edge(spark))
    assert out.columns == edge(spark).columns
    rows = out.collect()
    assert sum(NEAR in (r["text"] or "").lower() for r in rows) == 1
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 2, 3, 4, 5, 9, 10, 12, 13, 14, 15]


# nearest neighbours

def test_recall_and_scores(spark):
    from sensortracks.llm.permindex import nearest

    path = "/root/testdata/sf0.01/embeddings.parquet"
    d = duckdb.sql(f"select vec_id, embedding from '{path}' order by vec_id").fetchnumpy()
    x, ids = np.stack([np.asarray(v, float) for v in d["embedding"]]), d["vec_id"]
    norms = np.linalg.norm(x, axis=1)
    out = nearest(spark.read.parquet(path), lambda c: c % 50 == 0).toPandas()
    hits = 0
    for q in ids[ids % 50 == 0]:
        mine = out[out["query_id"] == q].sort_values("rank")
        i = np.searchsorted(ids, q)
        score = (x * x[i]).sum(1) / (norms * norms[i])
        assert np.allclose(mine["score"], score[np.searchsorted(ids, mine["vec_id"])], atol=1e-12)
        score[i] = -2
        hits += len(set(ids[np.lexsort((ids, -score))[:5]]) & set(mine["vec_id"]))
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(mine["vec_id"])
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


@pytest.mark.parametrize("noise", [0.0, 0.05])
def test_recall_with_a_third_of_the_rows_as_copies(spark, noise):
    from sensortracks.llm.permindex import nearest

    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet' order by vec_id").fetchnumpy()
    x, ids = np.stack([np.asarray(v, float) for v in rows["embedding"]]), rows["vec_id"].astype(int)
    rng = np.random.default_rng(3)
    same = rng.permutation(len(x))[:len(x) // 3]
    x[same] = x[same[0]] + noise * np.linalg.norm(x[same[0]]) / 8 * rng.standard_normal((len(same), x.shape[1]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids.tolist(), x, strict=True)],
                               "vec_id long, embedding array<double>")
    out = nearest(df, lambda c: c % 10 == 0).toPandas()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = {True: [], False: []}
    for i in np.flatnonzero(ids % 10 == 0):
        score = unit @ unit[i]
        score[i] = -2
        mine = out[out["query_id"] == ids[i]]["score"].to_numpy()
        hits[i in same].append((mine >= np.sort(score)[-5] - 1e-9).sum() / 5)
    assert np.mean(hits[True]) >= 0.92 and np.mean(hits[False]) >= 0.92


def test_rows_of_one_id_spread_over_the_blocks(spark):
    from sensortracks.llm.permindex import dealt

    sizes = [r["count"] for r in dealt(spark.range(12_000).selectExpr("7L as vec_id", "id as row"), 3).groupBy(
        "block").count().collect()]
    assert len(sizes) == 3 and max(sizes) < 4400


def test_nearest_edges(spark):
    from sensortracks.llm.permindex import nearest

    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [None, 1.0], 1),
            (5, [2.0, 0.0], 1), (6, [1.0, 0.0], 1), (7, [1.0, 1.0], 1), (8, [1.0], 1), (None, [1.0, 0.0], 1), (50, [0.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in nearest(df, lambda c: c % 50 == 0).collect()]
    assert sorted(got) == [(0, 1, 5, 1.0), (0, 2, 6, 1.0), (0, 3, 7, 0.707107), (0, 4, 50, 0.0),
                           (50, 1, 7, 0.707107), (50, 2, 0, 0.0), (50, 3, 0, 0.0), (50, 4, 5, 0.0), (50, 5, 6, 0.0)]
    assert nearest(df.limit(0), lambda c: c % 50 == 0).count() == 0
    same = spark.range(9000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    got = nearest(same, lambda c: c == 50).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4]


# packing

@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(rule):
    from sensortracks.llm.pack import best_fit

    rng = np.random.RandomState(3)
    n = rng.randint(1, 100, 500)
    bins, offsets = best_fit(n, 100, max_docs=4, max_cost=6000, rule=rule)
    for b in range(bins.max() + 1):
        own = n[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and ((own ** 2).sum() <= 6000 or len(own) == 1)
        order = np.argsort(offsets[bins == b])
        assert (np.cumsum(own[order]) - own[order] == offsets[bins == b][order]).all()
    if rule == "norm":
        bins, _ = best_fit(n, 100)
        assert bins.max() + 1 <= 1.02 * n.sum() / 100 + 1


def test_tiny_texts_fill_their_sequences(spark):
    from sensortracks.llm.pack import pack_documents

    out = pack_documents(spark.range(8000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text"), BPE).toPandas()
    assert (out["length"] == 1).all() and out["sequence_id"].nunique() == 8
    assert out.groupby("sequence_id")["offset"].agg(lambda x: sorted(x) == list(range(len(x)))).all()


def test_pieces_and_sequences(spark):
    from sensortracks.llm.pack import pack, pack_documents

    library = Tokenizer.from_file(BPE)
    want = []
    for d, t, *_ in EDGE:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s:first if k == 0 else s + 1024]
            want.append((d, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    out = pack_documents(edge(spark), BPE).toPandas()
    got = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= 1024 and (own["length"].cumsum() - own["length"] == own["offset"]).all()
    assert pack_documents(empty(spark), BPE).count() == 0
    many = spark.range(6000).select((F.pmod(F.xxhash64("id"), F.lit(1024)) + 1).alias("length"), F.lit(1).alias("offset"))
    placed = pack(many, group=500).toPandas()
    assert placed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert placed["sequence_id"].nunique() <= 1.015 * placed["length"].sum() / 1024 + 1


# pipeline

def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline
    from sensortracks.llm.pii import _redact, personal_spans

    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    kept = [(d, t) for d, t in docs if any(c.isalpha() for c in t or "") and quality(t)[-1]]
    kept = [(d, t) for (d, t), c in zip(kept, components(kept), strict=True) if d == c]
    df = spark.createDataFrame(kept, "doc_id long, text string")
    from sensortracks.llm.pii import learn_field

    field, library = learn_field(df), Tokenizer.from_file(BPE)
    want = Counter()
    for d, t in kept:
        want[d] += len(library.encode(_redact(t, personal_spans(t, field)[1]), add_special_tokens=False).ids) + 1
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert out.groupby("doc_id")["length"].sum().to_dict() == dict(want)
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024


def test_stages_on_edges(spark):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for docs in (empty(spark), edge(spark)):
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
            assert (out.count() > 0) == (docs.count() > 0) or name == "quality"
