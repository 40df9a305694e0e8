"""Search invariants: resume adds nothing on a second pass, IVF recall against exact search, embedding retries,
exact cosine against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import embedding as E
from tessera.operators import search as S
from tessera.plans.retrieval import label_centroids
from tessera.plans.standins import Tables
from tessera.session import scratch_path

from conftest import SMALL


def test_resume_second_pass_adds_nothing(spark):
    t = Tables(spark, SMALL)
    src = t.documents.select(F.col("doc_id").alias("id"), "text")
    target = scratch_path(spark, "test-resume")
    emb = S.hash_embedder(16)
    first = S.resume_embed(src, spark.createDataFrame([], "id long"), emb, 16, target=target)
    n_first = spark.read.parquet(target).count()
    assert n_first == src.where(F.col("text") != "").select("id").distinct().count()
    second = S.resume_embed(src, spark.read.parquet(target), emb, 16, target=target)
    assert second.count() == 0
    assert spark.read.parquet(target).count() == n_first
    assert first is not None


def test_resume_limit_counts_full_batches(spark):
    t = Tables(spark, SMALL)
    src = t.documents.select(F.col("doc_id").alias("id"), "text")
    out = S.resume_embed(src, spark.createDataFrame([], "id long"), S.hash_embedder(8), 8, limit=70, batch=64)
    assert out.count() == 128


def test_cosine_topk_matches_numpy(spark):
    t = Tables(spark, SMALL)
    q = label_centroids(t)
    got = S.cosine_topk(t.embeddings, q, 5).collect()
    vecs = t.embeddings.select("vec_id", "embedding").collect()
    ids = np.array([r["vec_id"] for r in vecs])
    m = np.array([r["embedding"] for r in vecs], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for qr in q.collect():
        v = np.array(qr["vector"]) / np.linalg.norm(qr["vector"])
        s = np.round(m @ v, 6)
        order = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:5]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == qr["query_id"])
        assert [vid for _, vid in mine] == [int(ids[i]) for i in order]


def test_ivf_recall(spark):
    t = Tables(spark, SMALL)
    q = label_centroids(t)
    exact = {(r["query_id"], r["vec_id"]) for r in S.cosine_topk(t.embeddings, q, 10).collect()}
    approx = {(r["query_id"], r["vec_id"]) for r in
              S.ivf_search(t.embeddings, q, 10, lists=8, probes=8, seed=1).collect()}
    assert approx == exact                      # probing every cell is exact
    some = {(r["query_id"], r["vec_id"]) for r in S.ivf_search(t.embeddings, q, 10, lists=8, probes=3, seed=1).collect()}
    assert len(some & exact) / len(exact) >= 0.5


def test_embed_retry_is_bounded_and_a_wrong_shape_is_not_retried():
    calls = []

    def flaky(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise ConnectionError("down")
        return np.ones((len(texts), 4))
    waits = []
    assert S.embed_batch(flaky, ["a", "b"], 4, sleep=waits.append).shape == (2, 4) and waits == [5, 10]

    def down(texts):
        calls.append(texts)
        raise TimeoutError
    calls.clear()
    with pytest.raises(TimeoutError):
        S.embed_batch(down, ["a"], 4, attempts=3, sleep=waits.append)
    assert len(calls) == 3
    calls.clear()
    with pytest.raises(ValueError):
        S.embed_batch(lambda t: calls.append(t) or np.ones((len(t), 3)), ["a"], 4, sleep=waits.append)
    assert len(calls) == 1


def test_resume_embeds_each_text_once_and_takes_the_first(spark):
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        seen.add(len(texts))
        return np.array([[len(t)] for t in texts])
    src = spark.createDataFrame([(1, "late text", 5), (1, "first", 2), (2, "b", 1), (3, "", 1)],
                                "id long, text string, seq int")
    out = S.resume_embed(src, spark.createDataFrame([], "id long"), embed, 1, target=scratch_path(spark, "resume-once"),
                         order=["seq"])
    rows = sorted((r["id"], r["vector"]) for r in out.collect())
    assert rows == [(1, [5.0]), (2, [1.0])] and out.count() == 2 and seen.value == 2


def test_cosine_ties_rank_by_id_and_blocks_give_the_same(spark, monkeypatch):
    vecs = spark.createDataFrame([(i, [1.0, 2.0, 0.5]) for i in range(300, 0, -1)] + [(400, [0.0, 0.0, 1.0])],
                                 "vec_id long, embedding array<double>").repartition(7)
    q = spark.createDataFrame([(n, [1.0, 2.0, 0.5 + n / 1000]) for n in range(9)], "query_id long, vector array<double>")
    whole = S.cosine_topk(vecs, q, 5).collect()
    assert sorted(r["vec_id"] for r in whole if r["query_id"] == 0) == [1, 2, 3, 4, 5]
    monkeypatch.setattr(S, "QUERY_BLOCK_BYTES", 48)
    assert sorted(map(tuple, S.cosine_topk(vecs, q, 5).collect())) == sorted(map(tuple, whole))


def test_search_cells_widens_the_probe_until_k_vectors(spark):
    t = Tables(spark, SMALL)
    index = S.build_cells(t.embeddings, scratch_path(spark, "cells-test"), lists=8, seed=1)
    assert index.sizes.sum() == t.embeddings.count()
    got = S.search_cells(index, label_centroids(t), k=400, probes=1).groupBy("query_id").count().collect()
    assert got and all(r["count"] == 400 for r in got)


def test_fts_match_requires_all_terms(spark):
    docs = spark.createDataFrame([(1, "Licitação de obras na escola"), (2, "obras da ponte"), (3, "escola nova")],
                                 "doc_id long, text string")
    idx = S.fts_index(docs, "doc_id", ["text"])
    q = spark.createDataFrame([(10, "OBRAS escola")], "query_id long, text string")
    hits = S.fts_match(idx, q, 5, n_docs=docs).collect()
    assert [r["doc_id"] for r in hits] == [1]
    assert "de" not in {r["token"] for r in idx.collect()}   # stop word removed
    assert "licit" in {r["token"] for r in idx.collect()}  # stemmed
    whole = S.fts_index(docs, "doc_id", ["text"], stems=False)
    assert "licitacao" in {r["token"] for r in whole.collect()}  # accent folded


def test_rrf_fuse_sums_reciprocal_ranks(spark):
    text = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank long")
    vec = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, vec_id long, rank long")
    got = {r["doc_id"]: (r["score"], r["rank"]) for r in S.rrf_fuse(text, vec, k=3, c=60).collect()}
    assert got[11] == (round(1 / 62 + 1 / 61, 9), 1)
    assert got[10] == (round(1 / 61, 9), 2) and got[12][1] == 3


def test_terms_match_other_forms_of_the_word(spark):
    docs = spark.createDataFrame([(1, "Licitações públicas"), (2, "pública licitação"), (3, "publicou licitante 2x40")],
                                 "doc_id long, text string")
    q = spark.createDataFrame([(1, "LICITAÇÃO"), (2, "publicações"), (3, "2X40")], "query_id long, text string")
    index = S.store_index(docs, "doc_id", ["text"], scratch_path(spark, "forms-index"), 4)
    got = {(r["query_id"], r["doc_id"]) for r in S.fts_match(index, q, 5).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 3)} and index.n_docs == 3


@pytest.mark.parametrize("positions", [True, False])
def test_text_is_dealt_by_its_bytes_and_usual_words_change_nothing(spark, monkeypatch, positions):
    from tessera.operators import textindex
    docs = spark.createDataFrame([(i // 2, f"Licitações públicas públicas x{i} único{'abc'[i % 3]} licitação " + "obra " * (i % 4))
                                  for i in range(120)] + [(None, "obra"), (None, "obra"), (7, None), (8, "")],
                                 "doc_id long, text string")
    few = 2 * spark.sparkContext.defaultParallelism
    got = []
    for usual, each in ((1 << 30, 1 << 30), (0, 1 << 30), (1 << 30, 100)):
        monkeypatch.setattr(textindex, "USUAL_BYTES", usual)
        monkeypatch.setattr(textindex, "TEXT_BYTES", each)
        index = S.fts_index(docs, "doc_id", ["text"], positions=positions)
        plan = index._jdf.queryExecution().executedPlan().toString()
        assert (f", {few}), REPARTITION_BY_NUM" in plan) == (each > 100)
        got.append(sorted(str(tuple(r)) for r in index.collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == len(set(got[0]))
    held = {(r["token"], r["doc_id"]): r["tf"] for r in S.fts_index(docs, "doc_id", ["text"]).collect()}
    assert held["public", 5] == 4 and held["licit", 5] == 4 and held["obra", None] == 2


def test_usual_words_say_whether_they_are_indexed_and_grouping_compares_numbers_first(spark):
    from tessera.operators import textindex
    docs = spark.createDataFrame([("a", "obras de Licitação, 2x40"), ("b", "Obras de licitação 2X40 uma vez"), ("b", "De"),
                                  (None, "ponte sobre pontes"), (None, "Ponte")], "doc_id string, text string")
    usual = {r["word"]: (r["usual"], r["kept"]) for r in textindex._usual_stems(docs, 100, "portuguese").collect()}
    assert usual == {"obras": ("obras", True), "de": ("de", False), "licitação": ("licit", True), "2x40": ("2x40", True),
                     "ponte": ("pont", True)}
    index = S.fts_index(docs, "doc_id", ["text"], positions=True)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "keys=[_groupingexpression#" in plan and "hash(token#" in plan
    got = {(r["token"], r["doc_id"]): (r["tf"], r["positions"]) for r in index.collect()}
    assert got["pont", None] == (3, [1, 1, 3]) and got["2x40", "b"] == (1, [4]) and ("de", "b") not in got
    assert got["licit", "a"] == (1, [3]) and len(got) == index.count()


def plain_phrases(docs, asked):
    """(query, doc) -> (hits, first place), over lists of tokens."""
    import re
    words = lambda t: [w for w in re.split(r"[^\w]+", t.lower()) if w]
    stop, out = set(S.stop_words()), {}
    for q, phrase in asked:
        need = [(i, w) for i, w in enumerate(words(phrase)) if w not in stop]
        for d, text in docs:
            own = words(text)
            at = [p for p in range(-len(own), len(own)) if need and all(
                0 <= p + i < len(own) and own[p + i] == w and w not in stop for i, w in need)]
            if at:
                out[q, d] = (len(at), min(at) + 1)
    return out


@pytest.mark.parametrize("stored", [True, False])
def test_phrases_against_plain_search(spark, stored):
    import random
    rnd = random.Random(4)
    vocab = ["kiwi", "grub", "de", "a", "golf", "x1"]
    docs = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 40)))) for i in range(60)] + [(99, "kiwi " * 500)]
    asked = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(1, 4)))) for i in range(40)]
    asked += [(50, "kiwi kiwi kiwi"), (51, "kiwi missing"), (52, "de a"), (53, "golf de grub"), (54, "")]
    ddf = spark.createDataFrame(docs, "doc_id long, text string")
    index = (S.store_index(ddf, "doc_id", ["text"], scratch_path(spark, "phrase-index"), 5, stems=False) if stored
             else S.fts_index(ddf, "doc_id", ["text"], positions=True))
    got = S.fts_phrase(index, spark.createDataFrame(asked, "query_id long, text string")).collect()
    assert {(r["query_id"], r["doc_id"]): (r["hits"], r["first_place"]) for r in got} == plain_phrases(docs, asked)
    assert len(got) == len({(r["query_id"], r["doc_id"]) for r in got})


def test_stored_index_reads_asked_buckets_only_and_keeps_positions_as_differences(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat_ws(' ', repeat('kiwi ', 40), id, 'golf') as text")
    index = S.store_index(docs, "doc_id", ["text"], scratch_path(spark, "wide-index"), 8)
    assert index.n_docs == 3000 and index.terms.where("token = 'kiw'").first()["df"] == 3000
    import glob

    import pyarrow.parquet as pq
    path = index.path.replace("file:", "")
    seen = set()
    for f in glob.glob(f"{path}/postings/*/*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        for i in range(group.num_columns):
            if group.column(i).path_in_schema.startswith("positions"):
                seen |= set(group.column(i).encodings)
    assert "DELTA_BINARY_PACKED" in seen
    asked = spark.createDataFrame([(1, "golf")], "query_id long, text string")
    S.fts_match(index, asked, 3)
    plan = index.postings.where(F.col("bucket") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


class Broken(Exception):
    pass


def test_a_pass_that_breaks_off_keeps_its_committed_slices(spark):
    """Slices are committed while the pass runs; the second pass asks only for what is missing."""
    asked, limit = spark.sparkContext.accumulator(0), 400

    def embedder(fails):
        def embed(texts):
            if fails and any(int(t.split()[1]) % 1000 == 777 for t in texts):
                raise RuntimeError("the endpoint is gone for good")
            asked.add(len(texts))
            return np.array([[len(t), int(t.split()[1])] for t in texts])
        return embed
    src = spark.range(limit * 10).selectExpr("id", "concat('text ', id) as text")
    target = scratch_path(spark, "crash-table")
    with pytest.raises(Exception, match="gone for good"):
        S.resume_embed(src, None, embedder(True), 2, target=target, slice_rows=limit, at_once=1)
    table = E.EmbeddedTable(spark, target)
    kept = {r["id"] for r in table.rows("id bigint, vector array<float>").collect()}
    assert 0 < len(kept) < 4000 and len(table.open_passes()) == 1
    before = asked.value
    out = S.resume_embed(src, None, embedder(False), 2, target=target, slice_rows=limit)
    assert asked.value - before == 4000 - len(kept)
    rows = table.rows("id bigint, vector array<float>").collect()
    assert {r["id"]: list(r["vector"]) for r in rows} == {i: [len(f"text {i}"), float(i)] for i in range(4000)}
    assert len(rows) == 4000 == out.count() and table.open_passes() == [] and len(table.committed()) == 1
    assert S.resume_embed(src, None, embedder(True), 2, target=target).count() == 0
    more = spark.range(4005).selectExpr("id", "concat('text ', id) as text")
    assert S.resume_embed(more, None, embedder(False), 2, target=target).count() == 5
    assert spark.read.parquet(target).count() == 4005


def test_calls_are_in_flight_side_by_side_in_order_and_bounded():
    import threading
    import time
    now, most, taken = [0], [0], [0]
    lock = threading.Lock()

    def call(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return i * i

    def items():
        for i in range(40):
            taken[0] = i + 1
            yield i
    began = time.time()
    out = E.in_order(items(), call, 8)
    assert next(out) == 0 and taken[0] <= 8     # no item is taken before there is room for its call
    assert list(out) == [i * i for i in range(1, 40)]
    assert most[0] == 8 and time.time() - began < 40 * 0.02 / 3
    done = []

    def fails(i):
        if i == 5:
            raise Broken
        time.sleep(0.01)
        done.append(i)
    with pytest.raises(Broken):
        list(E.in_order(range(1000), fails, 4))
    assert len(done) < 20


def test_a_sleeping_embedder_is_asked_side_by_side(spark):
    import time

    def slow(texts):
        time.sleep(0.25)
        return np.ones((len(texts), 2))
    df = spark.range(16).selectExpr("id", "cast(id as string) as text").repartition(1)
    took = {}
    for workers in (1, 8):
        began = time.time()
        got = E.batch_embed(df, "id", "text", slow, 2, batch=1, workers=workers).collect()
        took[workers] = time.time() - began
        assert sorted(r["id"] for r in got) == list(range(16))
    assert took[8] < took[1] - 1.5


def test_each_text_is_embedded_once_for_several_query_blocks(spark, monkeypatch):
    asked = spark.sparkContext.accumulator(0)

    def embed(texts):
        asked.add(len(texts))
        return np.array([[t.count(c) + 1.0 for c in "abc"] for t in texts])
    docs = spark.range(20).selectExpr("id as doc_id", "repeat('a b', int(id % 5)) as text")
    queries = spark.range(9).selectExpr("id as query_id", "concat('a ', repeat('b', int(id))) as text")
    vecs = S.batch_embed(docs, "doc_id", "text", embed, 3)
    own = S.batch_embed(queries, "query_id", "text", embed, 3).withColumnRenamed("id", "query_id")
    index = S.store_index(docs, "doc_id", ["text"], scratch_path(spark, "once-index"), 4)
    monkeypatch.setattr(S, "QUERY_BLOCK_BYTES", 72)
    S.hybrid_search(index, vecs, queries.join(own, "query_id"), 3, id_col="id", vec_col="vector").collect()
    assert asked.value == 29
