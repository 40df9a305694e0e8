"""Large counts and ids, whole feature sets, repeated rows and rows without id; plain forms of what is learned or dealt."""

import base64
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, common, exact_dedup, langid, ngram_lm, packing, queries, sharding, toxicity
from tests.llm.conftest import frame
from tests.llm.test_learned import check_scores, crc, tokens


# --- operator 7 ------------------------------------------------------------------------------------------------------

def test_counts_beyond_32_bits():
    key = np.array([7], np.uint64)
    table = pa.table({"shard": [0, 0], "block": [1, 2], "keys": [ngram_lm._squeeze(key)] * 2,
                      "counts": [ngram_lm._squeeze(np.array([3_000_000_000], np.uint32))] * 2})
    rows = ngram_lm._add_words(table).to_pylist()
    assert rows[0]["n_tokens"] == 6_000_000_000
    for r in rows[1:]:
        row = {"doc_ids": b"", "held": b"", "lengths": b"", "keys": ngram_lm._squeeze(key),
               "tokens": ngram_lm._squeeze(np.zeros(0, np.uint32))}
        block = ngram_lm.Block(row, [(0, r["counts"], r["numbers"])], np.zeros(1, np.uint64))
        assert block.count.tolist() == [6_000_000_000]


def key_of(word):
    if word is None:
        return int(ngram_lm.END)
    return int(common.word_keys(np.frombuffer(word + b" ", np.uint8), ngram_lm._IS_WORD)[1][0])


def brute_parts(rows, held, hot):
    """Scores with every hot context in parts by its successor's key."""
    train = [tokens(t) for d, t in rows if not held(d)]
    c = Counter(w for own in train for w in own)
    n, v = sum(c.values()), len(c)
    base = lambda w: (c[w] + 1) / (n + v + 1)
    part = lambda h, w: key_of(w) % ngram_lm.PARTS if c[h] * hot > n and c[w] else 0
    mass = Counter()
    for w in c:
        mass[key_of(w) % ngram_lm.PARTS] += base(w)
    mass[0] += 1 / (n + v + 1)
    after = defaultdict(Counter)
    for own in train:
        for h, w in zip([None, *own], own):
            after[h, part(h, w)][w] += 1

    def prob(h, w):
        if not c[h]:
            return base(w)
        own, whole = after[h, part(h, w)], mass[part(h, w)] if c[h] * hot > n else 1.0
        if own[w]:
            return (own[w] - 0.75) / (c[h] + 1)
        seen = [x for x in own if own[x]]
        return (0.75 * len(seen) + whole) / ((c[h] + 1) * (whole - sum(map(base, seen)))) * base(w)
    out = {}
    for d, t in rows:
        own = tokens(t)
        out[d] = (held(d), len(own), sum(c[w] > 0 for w in own), n, sum(math.log10(base(w)) for w in own),
                  sum(math.log10(prob(h, w)) for h, w in zip([None, *own], own)))
    return out


@pytest.mark.parametrize("hot", [40, 1 << 30])
def test_lm_with_hot_contexts_equals_brute_force(spark, texts, hot):
    rows = sorted(texts.items())[:60]
    before = {t.name for t in spark.catalog.listTables()}
    got = ngram_lm.score(frame(spark, rows), common.held_out("doc_id", 7, 2), hot=hot).collect()
    check_scores(got, brute_parts(rows, lambda d: crc(d) % 7 == 2, hot))
    assert {t.name for t in spark.catalog.listTables()} == before  # no scratch table is left behind


# --- operator 4 ------------------------------------------------------------------------------------------------------

def coded(tmp_path, ranks):
    path = tmp_path / "ranks.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {n}\n" for t, n in ranks.items()))
    coder = bpe._Coder(str(path), public_tokenizers.PATTERN)
    want = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: [int(x) for own in coder.code([t])[0] if own[0] for x in own[1].split(",")], want.encode_ordinary


def test_ids_above_twenty_bits(tmp_path, texts):
    ranks = bpe.read_ranks(queries.BPE_RANKS)
    some = {t: n + 1_500_000 for t, n in sorted(ranks.items(), key=lambda x: x[1])[:3000]}
    ours, theirs = coded(tmp_path, some)
    for t in itertools.islice(texts.values(), 20):
        assert ours(t) == theirs(t)


def test_two_space_token_at_the_end_of_a_text(tmp_path):
    ours, theirs = coded(tmp_path, {**{bytes([i]): i for i in range(256)}, b"  ": 256, b"ab": 257})
    for t in ("a  ", "  ", "a  b", "a   ", "ab  \n", " a  ", "   ", "a \n", "ab ab  "):
        assert ours(t) == theirs(t), repr(t)
    assert ours("a  ") == [97, 256]


# --- operator 3 ------------------------------------------------------------------------------------------------------

def plain_ftrl(rows, labels):
    z, n = Counter(), Counter()

    def weight(i):
        over = abs(z[i]) - (0 if i == toxicity.SIZE else toxicity.L1)
        return 0.0 if over <= 0 else -math.copysign(over, z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA
                                                                  + toxicity.L2)
    order = np.random.default_rng(7).permutation(len(rows))
    for _ in range(toxicity.PASSES):
        for r in order:
            at = [*rows[r], toxicity.SIZE]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - labels[r]
            for i in at:
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - step * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i) and i != toxicity.SIZE}, weight(toxicity.SIZE)


def test_weights_and_scores_equal_a_plain_form(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 1.0)
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices("rot cabbage lovely flower you are a the day".split(), k=rnd.randint(0, 12))) for _ in range(80)]
    labels = np.array([int("rot" in t and "you" in t) for t in texts])
    row, place = toxicity.features(texts)
    rows = [np.unique(place[row == i]) for i in range(len(texts))]
    model = toxicity.fit(rows, labels)
    weights, bias = plain_ftrl([r.tolist() for r in rows], labels)
    assert dict(zip(model.places.tolist(), model.weights)) == pytest.approx(weights) and len(weights) > 5
    assert model.bias == pytest.approx(bias)
    want = [1 / (1 + math.exp(-(bias + sum(weights.get(i, 0) for i in r.tolist())))) for r in rows]
    assert toxicity.scores(texts, model) == pytest.approx(want)


def test_a_learning_text_keeps_all_its_features_and_the_sample_has_fewer_rows(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(40_000))
    docs = frame(spark, [(i, long + f" x{i}") for i in range(12)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda rows, y: seen.update(rows=rows, y=y))
    toxicity.train(docs, labels)
    assert [len(r) for r in seen["rows"]] and min(map(len, seen["rows"])) > 110_000 and len(seen["rows"]) == 12
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 5 * 4 * 120_000)
    toxicity.train(docs, labels)
    assert 2 <= len(seen["rows"]) <= 5 and min(map(len, seen["rows"])) > 110_000


def test_learning_rows_come_in_parts_and_the_largest_of_an_id_is_used(spark, monkeypatch):
    from pyspark.sql import DataFrame
    texts = {i: f"rot cabbage you are w{i}" if i % 2 else f"flower {i}" for i in range(20)} | {20: "", 21: None}
    docs = frame(spark, [*texts.items(), (3, "rot"), (3, ""), (4, "flower 4")]).repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id bigint, toxic int")

    def whole(_):
        raise AssertionError("the sample came whole")
    seen = {}
    monkeypatch.setattr(DataFrame, "toArrow", whole)
    monkeypatch.setattr(toxicity, "fit", lambda rows, y: seen.update(rows=rows, y=y))
    toxicity.train(docs, labels)
    order = sorted(i for i in texts if not i % 2) + sorted(i for i in texts if i % 2)
    assert seen["y"].tolist() == [i % 2 for i in order]
    assert [r.tolist() for r in seen["rows"]] == [np.unique(toxicity.features([texts[i]])[1]).tolist() for i in order]


# --- operators 6 and 8 -----------------------------------------------------------------------------------------------

def plain_differencing(sizes, k):
    """Sums of the partition, by lists kept sorted by spread."""
    parts = [[0] * (k - 1) + [s] for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])  # the largest spread first
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted(x + y for x, y in zip(a, reversed(b))))
    return parts[0]


@pytest.mark.parametrize("k", [2, 3, 7])
def test_differencing_equals_a_plain_form(k):
    rnd = random.Random(k)
    for n in (1, 2, 5, 40):
        sizes = rnd.sample(range(1, 10 ** 6), n)
        sums = [0] * k
        for s, (p,) in zip(sizes, sharding.difference([[s] for s in sizes], k)):
            sums[p] += s
        assert sorted(sums) == plain_differencing(sizes, k)


def test_blocks_of_blocks_are_combined_until_one_is_left(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN", 3)
    rnd = random.Random(2)
    rows = [(b, p, rnd.randint(0, 10 ** 5)) for b in range(40) for p in range(4)]
    got = sharding._shard_of_parts(spark.createDataFrame(rows, "block bigint, part int, bytes bigint"), 4).collect()
    shard = {(r["block"], r["part"]): r["shard"] for r in got}
    assert set(shard) == {(b, p) for b, p, _ in rows} and len(got) == 160
    assert all({shard[b, p] for p in range(4)} == {0, 1, 2, 3} for b in range(40))
    sums = Counter()
    for b, p, s in rows:
        sums[shard[b, p]] += s
    assert max(sums.values()) - min(sums.values()) < 10 ** 5


def test_exact_dedup_keeps_one_of_repeated_rows_and_rows_without_id(spark):
    rows = [(1, "a"), (1, "a"), (1, "A"), (None, "b"), (None, "B"), (None, "c"), (3, "c"), (3, "c"), (4, None), (4, "")]
    before = {t.name for t in spark.catalog.listTables()}
    out = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    kept = sorted((r["doc_id"] or 0, r["group_size"]) for r in out if r["kept"])
    assert len(out) == len(rows) and kept == [(0, 2), (1, 3), (3, 3), (4, 2)]
    assert all(r["keep_id"] == r["doc_id"] for r in out if r["kept"])
    assert {t.name for t in spark.catalog.listTables()} == before
    index = exact_dedup.DigestIndex(spark, buckets=2)
    index.add(frame(spark, rows))
    assert not any(r["kept"] for r in index.add(frame(spark, rows)).collect())
    index.close()


# --- rows that share an id, and rows without one ---------------------------------------------------------------------

def test_every_row_is_a_row_of_its_own(spark):
    rows = [(7, "the same words in every copy"), (7, "the same words in every copy"), (7, "other words here"),
            (None, "no id at all"), (None, "no id at all"), (None, None), (8, None)]
    docs = frame(spark, [(d, t, "en") for d, t in rows])
    labels = spark.createDataFrame([(7, 1), (7, 0), (None, 1), (8, 0)], "doc_id bigint, toxic int")
    want = Counter(d for d, _ in rows)
    for out in (langid.identify(docs, docs), toxicity.score(docs, toxicity.train(docs, labels)),
                bpe.round_trip(docs, queries.BPE_RANKS, public_tokenizers.PATTERN), sharding.shard_by_bytes(docs, 2),
                ngram_lm.score(docs, common.held_out("doc_id", 7, 2)), exact_dedup.exact_dedup(docs)):
        assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == want
    pieces = packing.pack(docs, queries.PACKING_TOKENIZER).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == want
    by = defaultdict(list)
    for r in pieces:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
    slots = sharding.shard_by_bytes(docs, 2).groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert all(r["s"] == list(range(len(r["s"]))) for r in slots)


# --- operator 1 ------------------------------------------------------------------------------------------------------

def test_winner_and_score_equal_a_plain_parse():
    """Cost per language: phrases of a longest-match parse times log2 of its sample; the cheapest wins."""
    from tests.llm.test_learned import longest_phrases
    rng = np.random.default_rng(3)
    samples = {"x": ["".join(rng.choice(list("abc d"), 300)), "bad cab"], "y": ["".join(rng.choice(list("cdef "), 200))],
               "z": ["".join(rng.choice(list("gh i"), 90))]}
    model = langid.train(samples)
    texts = ["".join(rng.choice(list(letters), n)) for letters in ("abcd ", "cdef", "gh i", "acfgz") for n in (3, 40, 700)]
    names, scores, letters, _ = langid.judge([*texts, None, "", " 12 "], model)
    size = {k: sum(len(langid.encode(t, model.codes)) + 1 for t in own) for k, own in samples.items()}
    for t, name, score in zip(texts, names, scores):
        plain = "".join(map(chr, langid.encode(t, model.codes)))
        cost = {}
        for k, own in samples.items():
            whole = "".join(chr(0) + "".join(map(chr, langid.encode(p, model.codes))) for p in own)
            cost[k] = longest_phrases(plain, whole) * math.log2(size[k])
        assert name == min(sorted(cost), key=cost.get)
        assert score == pytest.approx(1 / sum(2 ** (-(c - min(cost.values())) / langid.SOFTEN) for c in cost.values()))
    assert names[len(texts):] == ["und"] * 3


@pytest.mark.parametrize("hot", [1, 40])
def test_a_stored_model_scores_other_documents_as_brute_force_does(spark, texts, hot):
    rows = sorted(texts.items())[:50]
    held = lambda d: crc(d) % 7 == 2 or d > 1000
    scores, model = ngram_lm.train_and_score(frame(spark, rows), common.held_out("doc_id", 7, 2), hot)
    check_scores(scores.collect(), brute_parts(rows, lambda d: crc(d) % 7 == 2, hot))
    others = [(1001, rows[3][1]), (1002, "entirely unknown wordage"), (1003, None), (None, rows[5][1][:300]),
              (1004, rows[7][1][::-1])]
    got = ngram_lm.score_by(model, frame(spark, others)).collect()
    want = brute_parts([*rows, *[(d, t) for d, t in others if d]], held, hot)
    assert all(r["held_out"] for r in got) and len(got) == len(others)
    check_scores([r for r in got if r["doc_id"]], {d: want[d] for d, _ in others if d})
    assert model.tries().count() <= model.shards and ngram_lm.score_by(model, frame(spark, [])).count() == 0
