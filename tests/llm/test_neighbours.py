"""SimHash near-duplicates, components, exact top-k: against brute force and on odd rows."""

import itertools
import math
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import queries, simhash, topk
from tessera.llm.components import components
from tests.llm.conftest import ODD, SMALL, frame


def brute_fingerprint(text, k=4):
    low = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    shingles = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(prints, bits=4):
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in prints}


def test_simhash_query_equals_brute_force(spark, texts):
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    group = brute_components(prints)
    got = queries.QUERIES["op5_simhash"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {
        d: (f"{p:016x}", group[d]) for d, p in prints.items()}


def test_simhash_odd_rows(spark, odd, empty):
    short = [t for t in ODD if t[0] not in (4, 5)]
    prints = {d: brute_fingerprint(t) for d, t in short}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect()}
    assert {d: got[d]["fingerprint"] % 2 ** 64 for d in prints} == prints
    assert got[5]["component_id"] == 4 and got[3]["component_id"] == got[12]["component_id"] == 1
    assert simhash.near_duplicates(empty).count() == 0
    lost = simhash.near_duplicates(frame(spark, [(None, "no id at all"), (7, "no id at all"), (None, "other words"),
                                                 (7, "no id at all")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in lost) == [(0, 0), (0, 7), (7, 7), (7, 7)]


@pytest.mark.parametrize("short_list, long_list", [(48, 1 << 16), (2, 1 << 16), (48, 20), (4, 3)])
def test_links_connect_what_is_near(spark, monkeypatch, short_list, long_list):
    """Also when lists are long enough to be searched, or to be filed again under one more byte."""
    monkeypatch.setattr(simhash, "SHORT_LIST", short_list)
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    rng = np.random.default_rng(4)
    values = {int(x) for x in rng.integers(0, 1 << 62, 120)}
    for centre in list(values)[:6]:
        for _ in range(40):
            x = centre
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            values.add(x)
    prints = dict(enumerate(sorted(values)))
    rows = [((p ^ (1 << 63)) - (1 << 63) if p >= 1 << 63 else p, n) for n, p in prints.items()]
    nodes = spark.createDataFrame(rows, "fingerprint bigint, node bigint")
    got = {r["node"]: r["component"] for r in components(simhash.links(nodes, 4)).collect()}
    assert {n: got.get(n, n) for n in prints} == brute_components(prints)


def test_position_sets_meet_every_four_positions():
    sets = simhash.position_sets()
    assert len(sets) == 20
    assert all(any(set(s) <= set(four) for s in sets) for four in itertools.combinations(range(8), 4))


def test_majority_counts_long_groups():
    rng = np.random.default_rng(0)
    groups = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 255, 256, 700)]
    starts = np.cumsum([0, *map(len, groups)])[:-1]
    for g, got in zip(groups, simhash.majority(np.concatenate(groups), starts)):
        assert int(got) == sum((2 * sum(int(x) >> b & 1 for x in g) > len(g)) << b for b in range(64))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                                 "vec_id bigint, embedding array<float>, score string, rank int")


def brute_top(rows, asked, k):
    ok = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows
          if v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in asked:
        if q in ok:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items()
                          if i != q and len(v) == len(ok[q]))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best[:k])}
    return out


@pytest.mark.parametrize("block", [800, 1 << 20])
def test_top_k_with_ties_and_odd_rows(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=33).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]
    rows += [(400, None), (401, []), (402, [float("nan")] * 33), (403, [None, *[1.0] * 32]), (404, [float("inf")] * 33),
             (405, [1.0, 2.0]), (410, [0.0] * 33)]
    own = topk.integer_vectors(vectors(spark, rows))
    asked = [i for i, _ in rows if i % 5 == 0]
    got = topk.top_k(own, own.where("vec_id % 5 = 0"), 5, block_bytes=block).collect()
    assert {tuple(r) for r in got} == brute_top(rows, asked, 5)
    twice = own.union(own.where("vec_id = 10"))
    again = [tuple(r) for r in topk.top_k(twice, twice.where("vec_id = 10"), 5).collect()]
    assert set(again) == {r for r in brute_top(rows, [10], 5)} and len(again) == 5
    assert topk.top_k(own.limit(0), own.limit(0), 5).count() == 0
    assert topk.top_k(own, own.limit(0), 5).count() == 0


def test_segment_bound_holds():
    rng = np.random.default_rng(3)
    for size in (1, 5, 33, 64):
        x, y = rng.normal(size=(50, size)) * 100, rng.normal(size=(50, size)) * 100
        last = None
        for a, b in zip(topk.weighted_stats(x), topk.weighted_stats(y)):
            bound = a @ b.T
            assert (bound + 1e-6 >= x @ y.T).all()
            assert last is None or (bound <= last + 1e-6).all()
            last = bound


@pytest.mark.parametrize("top", [20, 24, 26, 28, 30])
def test_top_k_is_exact_for_large_numbers(spark, top):
    """Whole numbers whose products pass 2**53; ties and neighbours differ by one unit."""
    rng = np.random.default_rng(top)
    base = rng.integers(-(1 << top), 1 << top, (12, 8 if top == 30 else 64))
    rows = [(i, base[i % 12].tolist()) for i in range(60)]
    for i in range(12, 60):
        rows[i][1][i % 7] += i % 3 - 1
    own = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>").repartition(3)
    got = topk.top_k(own, own.where("vec_id % 5 = 0"), 5).collect()
    want = set()
    for q, v in rows[::5]:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_products_beyond_a_long_are_an_error_and_up_to_it_exact():
    big = np.array([[2 ** 61, 3]], np.int64)
    for q, want in (([3, 5], 3 * 2 ** 61 + 15), ([-4, 1], -2 ** 63 + 3)):
        q = np.array(q, np.int64)
        got = topk.exact_products(big, q, np.array([2.0 ** 61]), float(np.sqrt((q ** 2).sum())))
        assert got.tolist() == [want]
    with pytest.raises(OverflowError):
        topk.exact_products(big, np.array([4, 0], np.int64), np.array([2.0 ** 61]), 4.0)
