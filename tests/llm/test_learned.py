"""Language identification, toxicity, n-gram scores: held-out accuracy, brute force, odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import elias_fano, langid, ngram_lm, queries, toxicity
from tests.llm.conftest import LONG, ODD, frame

MEDIUM = "/root/testdata/sf0.01"


def crc(d):
    return zlib.crc32(str(d).encode())


def test_language_of_held_out_documents(spark):
    out = queries.QUERIES["op1_language_id"](spark, MEDIUM)
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) >= 0.97


def longest_phrases(text, sample):
    """Brute-force cross-parse: the longest stretch from here on that the sample holds, with the letter after it if the
    sample never holds that letter; then on from its end."""
    n, at = 0, 0
    while at < len(text):
        m = 0
        while at + m < len(text) and text[at:at + m + 1] in sample:
            m += 1
        if at + m < len(text) and text[at + m] not in sample:
            m += 1
        n, at = n + 1, at + m
    return n


def test_phrases_equal_brute_force():
    rng = np.random.default_rng(0)
    sample = "".join(rng.choice(list("abc de"), 400))
    model = langid.train({"x": [sample]})
    coded = "".join(map(chr, langid.encode(" " + sample, model.codes)))
    found = []
    for n in (1, 7, 300, langid.BLOCK, 2500):
        text = "".join(rng.choice(list("abc def"), n))
        codes = langid.encode(text, model.codes)
        want = sum(longest_phrases("".join(map(chr, codes[i:i + langid.BLOCK])), coded)
                   for i in range(0, n, langid.BLOCK))
        found.append((codes, want))
    got = langid.parse([c for c, _ in found], model)[:, 0]
    assert got.tolist() == [w for _, w in found]


def test_packed_phrases_equal_brute_force():
    rng = np.random.default_rng(0)
    letters = [chr(0x4E00 + i) for i in range(300)] + [" "]
    sample = "".join(rng.choice(letters[-60:] * 5 + letters, 4000))
    model = langid.train({"x": [sample], "y": ["abc"]})
    assert isinstance(model.tables[0], langid.Packed) and not isinstance(model.tables[1], langid.Packed)
    coded = "".join(map(chr, langid.encode(" " + sample, model.codes)))
    texts = ["".join(rng.choice([*letters, "\u6000"], n)) for n in (1, 7, 300, 900)] + [sample[100:1000]]
    got = langid.parse([langid.encode(t, model.codes) for t in texts], model)[:, 0]
    assert got.tolist() == [longest_phrases("".join(map(chr, langid.encode(t, model.codes))), coded) for t in texts]


def test_languages_of_many_letters_beside_alphabets():
    """More letters in all than one table of codes holds, and languages of thousands of letters, as in clean texts."""
    rng = np.random.default_rng(0)

    def texts(first, letters, size, n):
        common = 1 / np.arange(1, 3001)
        words = ["".join(chr(first + int(x)) for x in rng.integers(0, letters, size)) for _ in common]
        return ["，".join(rng.choice(words, 80, p=common / common.sum())) for _ in range(n)]
    own = {"ko": texts(0xAC00, 2000, 2, 40), "zh": texts(0x4E00, 3000, 2, 60), "ja": texts(0x6000, 3000, 2, 50),
           "en": texts(ord("a"), 26, 5, 60), "ru": texts(0x430, 32, 5, 60), "el": texts(0x3B1, 24, 5, 60)}
    model = langid.train({name: t[:-10] for name, t in own.items()})
    for name, t in own.items():
        assert langid.judge(t[-10:], model)[0] == [name] * 10
        assert langid.accepts(t[-10:], model).all()
        # also what a short sample knows little of
        assert langid.accepts(t[-10:], langid.train({name: t[:1]})).all()
    assert not langid.accepts(["שלום עולם ומה שלומך", "", None, "123"], model).any()


def test_language_odd_rows(spark, empty):
    rows = [(100 + i, "the cat and the dog sat there with them", "en") for i in range(5)] + [
        (200 + i, "der hund und die katze sind nicht hier", "de") for i in range(5)]
    docs = frame(spark, ODD + rows + [(300, "123 !!"), (301, "Привет мир, как дела")])
    out = {r["doc_id"]: r for r in langid.identify(docs, docs).collect()}
    assert all(out[d]["lang_pred"] == "und" and out[d]["score"] == 0 for d in (1, 2, 3, 12, 300))
    assert out[100]["lang_pred"] == "en" and out[200]["lang_pred"] == "de"
    kept = {r["doc_id"] for r in langid.keep_identified(docs, docs).collect()}
    assert {100, 200} <= kept and not kept & {1, 2, 3, 12, 300, 301}
    assert langid.identify(empty, empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}


def test_toxicity_held_out(spark):
    out = {r["doc_id"]: r for r in queries.QUERIES["op3_toxicity"](spark, MEDIUM).collect()}
    assert all(r["held_out"] == (crc(d) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for d, r in out.items())
    marked = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    toxic = [out[d]["score"] for d, t in marked.items() if t == 1 and out[d]["held_out"]]
    clean = [out[d]["score"] for d, t in marked.items() if t == 0 and out[d]["held_out"]]
    assert np.mean([[a > b for b in clean] for a in toxic]) >= 0.85
    assert np.mean([s < 0.7 for s in clean]) >= 0.98


def test_toxicity_odd_rows(spark, empty):
    bad = [(1000 + i, f"you are a rotten cabbage number {i}") for i in range(40)]
    good = [(2000 + i, f"you are a lovely flower number {i}") for i in range(80)]
    docs = frame(spark, ODD + bad + good)
    labels = spark.createDataFrame([(d, 1) for d, _ in bad] + [(d, 0) for d, _ in good] + [(None, 1), (5, None),
                                   (1000, 0), (99999, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(out) == len(ODD + bad + good) and all(0 <= s <= 1 for s in out.values())
    assert min(out[d] for d, _ in bad) > max(out[d] for d, _ in good)
    assert out[1] == out[2]
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


def test_features_are_distinct_words_pairs_and_skips():
    row, place = toxicity.features(["a b c", "", None, "a b"])
    assert Counter(row.tolist()) == {0: 6, 3: 3}
    assert set(place[row == 3]) < set(place[row == 0])


def test_word_keys_do_not_depend_on_chunks(monkeypatch):
    from tessera.llm import common
    rng = np.random.default_rng(0)
    raw = np.frombuffer(b" ".join(b"abcdefgh"[: rng.integers(1, 9)] * int(rng.integers(1, 40)) for _ in range(900)),
                        np.uint8)
    is_word = np.ones(256, bool)
    is_word[0x20] = False
    whole = common.word_keys(raw, is_word)
    words = bytes(raw).split()
    key_of = {}
    assert len(whole[0]) == len(words)
    assert all(key_of.setdefault(w, k) == k for w, k in zip(words, whole[1])) and len(set(key_of.values())) == len(key_of)
    monkeypatch.setattr(common, "HASH_CHUNK", 100)
    for a, b in zip(whole, common.word_keys(raw, is_word)):
        assert (a == b).all()
    assert [len(x) for x in common.word_keys(raw[:0], is_word)] == [0, 0]


def tokens(text):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(low)), None]


def brute_scores(rows, held):
    train = [tokens(t) for d, t in rows if not held(d)]
    c = Counter(w for own in train for w in own)
    n, v = sum(c.values()), len(c)
    after = defaultdict(Counter)
    for own in train:
        for h, w in zip([None, *own], own):
            after[h][w] += 1

    def base(w):
        return (c[w] + 1) / (n + v + 1)
    back = {h: (0.75 * len(s) + 1) / ((c[h] + 1) * (1 - sum(map(base, s)))) for h, s in after.items()}

    def prob(h, w):
        if h not in after:
            return base(w)
        return (after[h][w] - 0.75) / (c[h] + 1) if after[h][w] else back[h] * base(w)
    out = {}
    for d, t in rows:
        own = tokens(t)
        out[d] = (held(d), len(own), sum(c[w] > 0 for w in own), n, sum(math.log10(base(w)) for w in own),
                  sum(math.log10(prob(h, w)) for h, w in zip([None, *own], own)))
    return out


def check_scores(got, want):
    assert {r["doc_id"]: tuple(r)[1:5] for r in got} == {d: w[:4] for d, w in want.items()}
    for r in got:
        base, model = want[r["doc_id"]][4:]
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        # a byte per probability: at most half a step of 1/20 decade a token
        assert abs(r["score"] - model) <= 0.03 * r["n_tokens"]


def test_lm_equals_brute_force(spark, texts):
    from tessera.llm.common import held_out
    rows = sorted(texts.items())
    got = ngram_lm.score(frame(spark, rows), held_out("doc_id", 7, 2), hot=1).collect()  # no context is hot
    check_scores(got, brute_scores(rows, lambda d: crc(d) % 7 == 2))


def test_lm_divides_hot_contexts(spark, texts):
    """Every context in parts: the same counts and base scores, and still a better model than the base."""
    from tessera.llm.common import held_out
    rows = sorted(texts.items())
    got = ngram_lm.score(frame(spark, rows), held_out("doc_id", 7, 2), hot=1 << 40).collect()
    want = brute_scores(rows, lambda d: crc(d) % 7 == 2)
    assert {r["doc_id"]: tuple(r)[1:5] for r in got} == {d: w[:4] for d, w in want.items()}
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_lm_odd_rows(spark, empty):
    from tessera.llm.common import held_out
    got = {r["doc_id"]: r for r in ngram_lm.score(frame(spark, ODD), held_out("doc_id", 7, 2)).collect()}
    assert len(got) == len(ODD) and got[1]["n_tokens"] == got[2]["n_tokens"] == 1
    assert got[4]["n_tokens"] == len(LONG.split()) + 1
    want = brute_scores(ODD, lambda d: crc(d) % 7 == 2)
    assert {d: r["base_score"] for d, r in got.items()} == pytest.approx({d: w[4] for d, w in want.items()})
    assert ngram_lm.score(empty, held_out("doc_id", 7, 2)).count() == 0


@pytest.mark.parametrize("contexts", [1, 40])
def test_trie_values_sum_to_one(contexts):
    rng = np.random.default_rng(contexts)
    v, total = 300, 5000
    c = rng.integers(1, 30, v)
    base = (c + 1) / (c.sum() + v + 1)
    sizes = rng.integers(1, 60, contexts)
    words = np.concatenate([np.sort(rng.choice(v, s, replace=False)) for s in sizes]).astype(np.uint64)
    counts = rng.integers(1, 9, len(words))
    first = np.cumsum(sizes) - sizes
    h = np.add.reduceat(counts, first)
    ids = (np.arange(contexts) * 7).astype(np.uint64) * np.uint64(ngram_lm.PARTS)
    trie = ngram_lm.Trie.mapped(ngram_lm.build_trie(ids, h, sizes, words, counts, base[words.astype(int)], np.ones(contexts)))
    for i in range(contexts):
        at, place = trie.lookup(np.full(v, ids[i]), np.arange(v).astype(np.uint64))
        weight = 10 ** ((float(trie.weights[at[0]]) - ngram_lm.WEIGHT_ONE) / ngram_lm.WEIGHT_STEPS)
        seen = 10 ** ((1 - trie.codes[np.maximum(place, 0)].astype(float)) / ngram_lm.PROB_STEPS)
        p = np.where(place >= 0, seen, weight * base)
        unknown = weight / (c.sum() + v + 1)
        assert p.sum() + unknown == pytest.approx(1, abs=0.05)
    assert total


def test_elias_fano_and_mapped_file(tmp_path):
    rng = np.random.default_rng(2)
    for n, top in ((0, 9), (1, 1), (2000, 50), (2000, 10 ** 12)):
        v = np.sort(rng.integers(0, top, n).astype(np.uint64))
        e = elias_fano.EliasFano(elias_fano.encode(v))
        assert (e.get(np.arange(n)) == v).all()
        x = rng.integers(0, top + 3, 500).astype(np.uint64)
        if n:
            assert (e.successor(x) == np.searchsorted(v, x)).all()
    layout = elias_fano.Trie.layout(np.array([3, 9], np.uint64), np.array([2, 1]), np.array([1, 5, 0], np.uint64),
                                    np.array([7, 8, 9]), np.array([100, 200]))
    (tmp_path / "levels").write_bytes(layout)
    trie = elias_fano.Trie.open(str(tmp_path / "levels"))
    at, place = trie.lookup(np.array([3, 3, 9, 9, 4], np.uint64), np.array([5, 2, 0, 1, 1], np.uint64))
    assert at.tolist() == [0, 0, 1, 1, -1] and place.tolist() == [1, -1, 2, -1, -1]
