"""Exact dedup, line dedup, sharding: against brute force and on odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, line_dedup, queries, sharding
from tests.llm.conftest import ODD, SMALL, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def test_exact_dedup_rows(spark, odd, empty):
    got = exact_dedup.exact_dedup(odd)
    no_python(got)
    groups = defaultdict(list)
    for d, t in ODD:
        groups[(t or "").translate(LOWER)].append(d)
    want = {d: (max(g), len(g), d == max(g)) for g in groups.values() for d in g}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()} == want
    assert want[1] == (2, 2, False) and want[6] == (8, 3, False)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_digest_index_grows_and_keeps_what_entered_first(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.add(frame(spark, [(1, "a"), (2, "A"), (3, "b")]))
    again = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.add(frame(spark, [(9, "a"), (8, "c")])).collect()}
    assert again == {9: (2, False), 8: (8, True)}
    assert sorted(r["keep_id"] for r in index.entries().collect()) == [2, 3, 8]
    reopened = exact_dedup.DigestIndex(spark, index.path, buckets=4)
    assert [r["kept"] for r in reopened.add(frame(spark, [(20, "B")])).collect()] == [False]


def test_index_side_of_the_anti_join_is_not_shuffled(spark):
    index = exact_dedup.DigestIndex(spark, buckets=8)
    index.add(frame(spark, [(1, "a")]))
    new = spark.createDataFrame([(b"x",)], "digest binary")
    plan = new.join(index.entries().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan"):]
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def runs_deleted(rows, least):
    """Brute force: cover every run of lines that also occurs earlier and has ``least`` words."""
    seq = [(d, i, line, len(re.findall(r"\S+", line, re.ASCII))) for d, t in sorted(rows) if t is not None
           for i, line in enumerate(t.split("\n"))]
    seq = [x for x in seq if x[3]]
    gone = defaultdict(set)
    for p in range(len(seq)):
        best = 0
        for q in range(p):
            m = 0
            while p + m < len(seq) and seq[p + m][0] == seq[p][0] and seq[q + m][0] == seq[q][0] \
                    and seq[p + m][2] == seq[q + m][2]:
                m += 1
            best = max(best, m)
        if best and sum(x[3] for x in seq[p:p + best]) >= least:
            for x in seq[p:p + best]:
                gone[x[0]].add(x[1])
    return {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
            for d, t in rows}


def test_suffix_ranks_order_and_group_the_suffixes(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "b\nc\nd\nx\na\nb\nc\nd"), (3, "c\nd\ne\na\nb")]
    lines = line_dedup.lines_of(frame(spark, rows)).cache()
    code = {(r["doc_id"], r["pos"]): bytes(r["h"]) for r in lines.collect()}
    for doublings in (0, 1, 2):
        k = 2 ** doublings
        prefix = {(d, p): tuple(code[d, p + i] for i in range(k)) for d, p in code if (d, p + k - 1) in code}
        counts = Counter(prefix.values())
        got = {(r["doc_id"], r["pos"]): r["r"] for r in line_dedup.suffix_ranks(lines, doublings).collect()}
        assert set(got) == {s for s, x in prefix.items() if counts[x] > 1}
        for s in got:
            for t in got:
                assert (got[s] < got[t]) == (prefix[s] < prefix[t])


CASES = [
    [(1, "a b\nc d\ne f\ng h"), (2, "x\na b\nc d\ne f\ny"), (3, "c d\n\ne f\ng h\nz"), (4, None), (5, ""), (6, "a b")],
    [(1, "a\na\na\na\na\na\na\na\na\na")],
    [(1, "one two three\nk"), (2, "k\none two three"), (3, "one two three\nk"), (4, "k\nk\nk\nk\nk\nk\nk\nk")],
    [(i, "\n".join("pqrs"[(i * j) % 4] * 2 for j in range(12))) for i in range(1, 9)],
]


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("least", [1, 3, 6])
def test_line_dedup_equals_brute_force(spark, rows, least):
    got = line_dedup.line_dedup(frame(spark, rows), least)
    no_python(got)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == runs_deleted(rows, least)


def test_line_dedup_odd_rows(spark, odd, empty):
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(odd).collect()}
    assert got[1]["text"] is None and got[2]["text"] == "" and got[4]["text"] == ODD[3][1]
    assert got[5]["emptied"] and not got[4]["emptied"] and got[6]["n_deleted"] == 0
    assert line_dedup.line_dedup(empty).count() == 0
    columns = line_dedup.line_dedup(odd).columns
    assert set(odd.columns) < set(columns) and len(set(columns)) == len(columns)
    assert line_dedup.without_later_copies(odd).columns == odd.columns


def test_passage_over_fifty_words_is_cut_and_the_rest_stays(spark):
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(7)) for i in range(9))
    rows = [(1, f"first own line\n{passage}\nend of one"), (2, f"{passage}\nsecond own line"), (3, "clean\nlines here")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "second own line", 3: rows[2][1]}


def test_rows_that_share_an_id_are_told_apart(spark):
    """The first of equal rows keeps its text; so does a line that another row of the id holds at the same place."""
    line, other = "one two three four five six seven eight", "a b c d e f g h"
    rows = [(1, f"{line}\n{other}")] * 2 + [(2, line), (3, "x y\nz"), (3, f"own words here\n{line}"), (None, line)]
    docs = frame(spark, rows)
    got = sorted((r["doc_id"] or 0, r["text"], r["n_deleted"], r["emptied"]) for r in line_dedup.line_dedup(docs).collect())
    assert got == [(0, line, 0, False), (1, "", 2, True), (1, rows[0][1], 0, False), (2, "", 1, True),
                   (3, "own words here", 1, False), (3, "x y\nz", 0, False)]
    kept = line_dedup.without_later_copies(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [
        (0, line), (1, rows[0][1]), (3, "own words here"), (3, "x y\nz")]


def test_sharding_rows(spark, odd, empty):
    out = sharding.shard_by_bytes(odd, 3).collect()
    byte = {d: (t or "").encode() for d, t in ODD}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out} == \
        {d: (len(b) + 8, zlib.crc32(b)) for d, b in byte.items()}
    home = defaultdict(set)
    for r in out:
        home[byte[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in home.values())
    for s in range(3):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert sharding.shard_by_bytes(empty, 3).count() == 0


def test_differencing_is_tight():
    import random
    rng = random.Random(3)
    sizes = [rng.randrange(10, 5000) for _ in range(2000)]
    place = sharding.difference([[s] for s in sizes], 24)
    sums = Counter()
    for s, (p,) in zip(sizes, place):
        sums[p] += s
    assert len(sums) == 24 and max(sums.values()) - min(sums.values()) <= 24
    two = sharding.difference([[8], [7], [6], [5], [4]], 2)
    assert sorted(sum(s for s, (p,) in zip([8, 7, 6, 5, 4], two) if p == k) for k in (0, 1)) == [14, 16]


def test_registered_shards_are_near_equal(spark):
    out = queries.QUERIES["op6_sharding"](spark, SMALL)
    sums = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    biggest = out.groupBy("text_crc32").agg(F.sum("size").alias("b")).agg(F.max("b")).first()[0]
    assert len(sums) == 24 and max(sums) - min(sums) <= biggest
