"""The pipeline: every stage on its own input, against brute force, and odd tables."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest

from tests.llm.conftest import ODD, SMALL, frame
from tests.llm.test_native import runs_deleted
from tests.llm.test_neighbours import brute_components, brute_fingerprint
from tests.llm.test_tokens import check_packing


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return {name: (before, after) for name, before, after in out}


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_columns_and_filters(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns
        if name in ("language_id", "toxicity"):
            assert set(pairs(after)) <= set(pairs(before))
    assert stages["language_id"][1].count() == stages["language_id"][0].count()


def test_line_stage_equals_brute_force(stages):
    before, after = stages["line_dedup"]
    want = runs_deleted(pairs(before), 8)
    old = dict(pairs(before))
    want = {d: t for d, t in want.items() if t == old[d] or t.strip()}
    assert dict(pairs(after)) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["text"] != old[r["doc_id"]])


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    before, after = stages["simhash_near_dedup"]
    group = brute_components({d: brute_fingerprint(t) for d, t in pairs(before)})
    assert [d for d, _ in pairs(after)] == sorted(d for d, g in group.items() if d == g)


def test_near_duplicate_stage_keeps_one_of_repeated_rows_and_rows_without_id(spark):
    rows = [(7, "the same words here"), (7, "the same words here"), (9, "the same words here"),
            (None, "the same words here"), (None, "no id at all"), (None, "no id at all"), (8, "of its own")]
    after = corpus_pipeline.near_duplicate_stage(spark, frame(spark, rows), SMALL)
    assert after.columns == frame(spark, rows).columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in after.collect()) == [
        (0, "no id at all"), (7, "the same words here"), (8, "of its own")]


def test_packing_stage(stages):
    before, after = stages["packing"]
    check_packing(pairs(before), after.collect())


def test_run_gives_the_last_stage(spark, stages):
    def key(r):
        return r["doc_id"], r["piece"], r["length"], r["ids_crc32"]
    assert sorted(map(key, corpus_pipeline.run(spark, SMALL).collect())) == sorted(
        map(key, stages["packing"][1].collect()))


@pytest.mark.parametrize("rows", [[], ODD + [(50 + i, f"some plain words here {i}", "en") for i in range(4)]])
def test_odd_tables_pass_through(spark, rows, tmp_path):
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert (docs.count() > 0) == bool(rows)


def test_language_and_toxicity_stages_equal_a_plain_judgement(spark, real, texts):
    """Every row judged by itself: phrases by brute force and the script rule; weights summed over a text's own features."""
    import math

    import numpy as np

    import corpus_pipeline
    from tessera.llm import langid, toxicity
    from tests.llm.test_learned import longest_phrases
    samples = langid.sample(real)
    model = langid.train(samples)
    whole = {k: "".join(chr(0) + "".join(map(chr, langid.encode(p, model.codes))) for p in own) for k, own in samples.items()}
    some = sorted(texts)[:25]
    for d in some:
        codes = langid.encode(texts[d][:langid.BLOCK], model.codes)
        cost = {k: longest_phrases("".join(map(chr, codes)), whole[k]) * bits
                for k, bits in zip(model.languages, model.phrase_bits)}
        assert langid.judge([texts[d][:langid.BLOCK]], model)[0] == [min(sorted(cost), key=cost.get)]
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, real, SMALL).collect()}
    assert kept == {d for d, t in texts.items() if langid.accepts([t], model)[0]}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic")
    learnt = toxicity.train(real, labels)
    weight = dict(zip(learnt.places.tolist(), learnt.weights.tolist()))
    clean = set()
    for d, t in texts.items():
        total = learnt.bias + sum(weight.get(p, 0.0) for p in np.unique(toxicity.features([t])[1]).tolist())
        if 1 / (1 + math.exp(-total)) < toxicity.THRESHOLD:
            clean.add(d)
    got = {r["doc_id"] for r in corpus_pipeline.toxicity_stage(spark, real, SMALL).collect()}
    assert got == clean and len(clean) < len(texts)
