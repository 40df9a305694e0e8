"""Packing and byte-level BPE against the libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, queries
from tests.llm.conftest import ODD

RANKS = bpe.read_ranks(queries.BPE_RANKS)
TABLE = bpe.PrefixBpe(RANKS)
REFERENCE = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check_packing(rows, out, capacity=2048):
    t = Tokenizer.from_file(queries.PACKING_TOKENIZER)
    pieces = defaultdict(dict)
    places = defaultdict(list)
    for r in out:
        assert r["piece"] not in pieces[r["doc_id"]]
        pieces[r["doc_id"]][r["piece"]] = r
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        own = [pieces[d][i] for i in range(len(pieces[d]))]
        first = len(ids) % capacity or capacity
        assert [(r["start"], r["length"]) for r in own] == [(0, first)] + [
            (s, capacity) for s in range(first, len(ids), capacity)]
        for r in own:
            cut = ids[r["start"]:r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), total


def test_packing_rows(spark, odd, empty):
    rows = ODD + [(13, "an <|endoftext|> inside"), (14, "a   b \n \n c")]
    from tests.llm.conftest import frame
    out = packing.pack(frame(spark, rows), queries.PACKING_TOKENIZER).collect()
    check_packing(rows, out)
    assert packing.pack(empty, queries.PACKING_TOKENIZER).count() == 0


def test_packing_query(spark, texts):
    out = queries.QUERIES["op2_packing"](spark, "/root/testdata/sf0.001").collect()
    sequences, total = check_packing(sorted(texts.items()), out)
    assert sequences <= -(-total // 2048) * 1.02 + 1


@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 60), max_size=80))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_piece_once(counts):
    got = Counter()
    for lengths, n in packing.pack_histogram(dict(counts)):
        assert n > 0 and sum(lengths) <= 2048
        for x in lengths:
            got[x] += n
    assert got == Counter(counts)


def test_plan_is_near_the_bound_for_many_documents():
    rng = np.random.default_rng(0)
    counts = Counter(np.clip(rng.lognormal(6.3, 1, 200_000), 1, 2048).astype(int).tolist())
    plan = packing.pack_histogram(dict(counts))
    assert sum(n for _, n in plan) <= 1.005 * sum(x * n for x, n in counts.items()) / 2048 + 1


def test_nnls_finds_a_known_solution():
    rng = np.random.default_rng(1)
    a = rng.random((30, 12))
    x = np.array([0, 2.0, 0, 1, 0, 0, 3, 0, 0.5, 0, 0, 4])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


def test_bpe_rows(spark, odd, empty):
    out = {r["doc_id"]: r for r in bpe.round_trip(odd, queries.BPE_RANKS, public_tokenizers.PATTERN).collect()}
    for d, t in ODD:
        ids = REFERENCE.encode_ordinary(t or "")
        assert out[d]["n_tokens"] == len(ids)
        assert out[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(empty, queries.BPE_RANKS, public_tokenizers.PATTERN).count() == 0
    some = {r["doc_id"]: r["ids"] for r in bpe.encode(odd, queries.BPE_RANKS, public_tokenizers.PATTERN).collect()}
    assert some[9] == REFERENCE.encode_ordinary(ODD[8][1])


def test_remembered_results_survive_a_change_of_generation(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    coder = bpe._Coder(queries.BPE_RANKS, public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(30):
        texts = [" ".join(rng.choice(["ab", "Cde.", "x1", "l'm", "é\nb", "  z", "q,"]) + str(rng.randrange(30) or "")
                          for _ in range(9)) for _ in range(3)] + ["", " ", " a", "a "]
        for t, own in zip(texts, coder.code(texts)):
            assert ",".join(x[1] for x in own if x[0]) == ",".join(map(str, REFERENCE.encode_ordinary(t)))
            assert b"".join(x[2] for x in own) == t.encode()


def test_bpe_query(spark, texts):
    for r in queries.QUERIES["op4_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = REFERENCE.encode_ordinary(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@given(st.binary(min_size=1, max_size=40) | st.text("ab cde'lmn0 ", min_size=1, max_size=60).map(str.encode))
@settings(max_examples=400, deadline=None)
def test_prefix_table_equals_lowest_rank_merging(piece):
    assert TABLE.encode_piece(piece) == REFERENCE._core_bpe.encode_single_piece(piece)
    assert TABLE.decode(TABLE.encode_piece(piece)) == piece


@given(st.lists(st.binary(min_size=1, max_size=50) | st.text("ab cde'lmn0 é", min_size=1, max_size=40).map(str.encode),
                min_size=1, max_size=30, unique=True))
@settings(max_examples=60, deadline=None)
def test_batch_table_equals_the_single_one(pieces):
    assert bpe.BatchBpe(TABLE).encode(pieces) == [TABLE.encode_piece(p) for p in pieces]


@pytest.mark.parametrize("unit", ["a", "ab", " ", "=", "é"])
def test_prefix_table_on_repeats(unit):
    for n in range(1, 60):
        piece = (unit * n).encode()
        assert TABLE.encode_piece(piece) == REFERENCE._core_bpe.encode_single_piece(piece)


def test_appends_and_edits_re_encode_exactly(texts):
    rng = random.Random(5)
    for _ in range(60):
        held = bpe.AppendableText(TABLE, public_tokenizers.PATTERN, rng.choice(list(texts.values()))[:300])
        for _ in range(6):
            new = "".join(rng.choice("ab  'se\n\té1!") for _ in range(rng.randrange(6)))
            at = rng.randrange(len(held.text) + 1)
            held.append(new) if rng.random() < 0.3 else held.edit(at, min(len(held.text), at + rng.randrange(5)), new)
            assert held.ids() == REFERENCE.encode_ordinary(held.text)
    long = bpe.AppendableText(TABLE, public_tokenizers.PATTERN, "some words here and there " * 500)
    assert long.edit(6000, 6001, "X") < 10
