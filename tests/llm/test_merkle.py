"""Merkle manifest: against a plain builder, SQL, and on odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, merkle, queries
from tests.llm.conftest import SMALL, frame


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain(rows, fanout=8):
    """{row index: (leaf, subroot, root, proof, folded)} for (doc_id, source, lang, n_chars, text)."""
    def climb(nodes):
        """Root and, per leaf, the (left, right) siblings."""
        steps, cover = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [range(i, min(i + fanout, len(nodes))) for i in range(0, len(nodes), fanout)]
            for run in runs:
                for i in run:
                    for leaf in cover[i]:
                        steps[leaf].append(("".join(nodes[x] for x in run if x < i), "".join(nodes[x] for x in run if x > i)))
            cover = [[leaf for i in run for leaf in cover[i]] for run in runs]
            nodes = [h(*(nodes[i] for i in run)) for run in runs]
        return nodes[0], steps
    parts = {}
    for i, r in enumerate(rows):
        parts.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(*map(field, r)), i))
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    own = {p: climb([x[2] for x in sorted(parts[p])]) for p in names}
    root, top = climb([own[p][0] for p in names])
    out = {}
    for p, above in zip(names, top):
        for (_, _, leaf, i), below in zip(sorted(parts[p]), own[p][1]):
            r = rows[i]
            acc = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                acc = h(*map(field, r[:4]), field(r[4].translate({x: x + 32 for x in range(65, 91)})))
            for left, right in below + above:
                acc = h(left, acc, right)
            out[i] = (leaf, own[p][0], root, h(*(a + b for a, b in below + above)), acc)
    return out


def run(docs, fanout=8):
    *others, text = [F.col(c) for c in merkle.FIELDS]
    low = merkle.leaf_digest(*others, exact_dedup.normalised(text))
    m = merkle.build(docs, merkle.leaf_digest(*others, text), F.col("lang"), F.col("doc_id"),
                     F.when(queries.held_out("doc_id", 3, 0) & text.isNotNull(), low), fanout)
    return m, merkle.proofs(m)


@pytest.mark.parametrize("fanout", [2, 8])
def test_proofs_of_odd_rows_equal_a_plain_builder(spark, fanout):
    rows = [(i, f"Text {i} Ä\x00é" * (i % 5), "en") for i in range(75)] + [(i, f"T{i}", "ä") for i in range(100, 108)]
    rows += [(200, "alone", "z"), (201, None, None), (202, "", None), (202, "", None), (202, "Other", None),
             (None, "No id", "en"), (None, "No id", "en"), (None, None, "en"), (300, "X" * 200_000, "B"), (301, "y", "a"),
             (302, "Z", "")]
    docs = frame(spark, rows)
    whole = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    m, out = run(docs, fanout)
    got = sorted(tuple(x or "" for x in r) for r in out.select(
        "leaf", "subroot", "root", "proof_sha256", "folded_root").collect())
    want = plain(whole, fanout)
    assert got == sorted(want.values())
    assert {r["verified"] for r in out.collect()} == {True, False}
    assert out.where("verified <> (folded_root = root)").count() == 0 and m.root == want[0][2]


def test_query_of_real_rows_equals_a_plain_builder(spark, real):
    whole = [tuple(r) for r in real.select(*merkle.FIELDS).collect()]
    want = {whole[i][0]: v for i, v in plain(whole).items()}
    got = queries.QUERIES["op12_merkle"](spark, SMALL).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in got} == want
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)


def test_small_tables(spark, empty):
    m, out = run(empty)
    assert m.root is None and out.count() == 0
    m, out = run(frame(spark, [(5, "One", "en")]))
    row = out.first()
    assert row["leaf"] == row["subroot"] == m.root and row["path"] == [] and row["proof_sha256"] == h()


def test_one_part_is_divided_and_no_plan_pairs_nodes(spark):
    m, out = run(frame(spark, [(i, str(i), "en") for i in range(600)]))
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert [x.count() for x in m.levels] == [600, 75, 10, 2, 1]
