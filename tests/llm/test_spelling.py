"""Spelling variants: counting, the position index and whole results against brute force."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import queries, spelling
from tests.llm.conftest import SMALL, frame


def brute_counts(rows, least=6, min_count=5):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{low}".encode())
            if doc_id is not None and h % 199 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            out[low] += len(low) >= least
    return {w: n for w, n in out.items() if n >= min_count}


def brute_near(words):
    out = {w: set() for w in words}
    cuts = {}
    for w in words:
        for i in range(len(w)):
            cuts.setdefault(w[:i] + w[i + 1:], []).append((i, w))
    for cut, own in cuts.items():
        for (i, a), (j, b) in itertools.permutations(own, 2):
            if i == j and a != b:
                out[a].add(b)
        if cut in out:
            for _, a in own:
                out[a].add(cut)
                out[cut].add(a)
    return out


def brute_groups(counts):
    near, form = brute_near(counts), {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def groups(counts):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in counts.collect()}


def test_query_equals_brute_force(spark, texts):
    got = queries.QUERIES["op13_spelling"](spark, SMALL)
    want = brute_groups(brute_counts(texts.items()))
    assert groups(got) == want and got.count() == len(want) and any(x[1] for x in want)


def test_index_finds_every_edit_and_nothing_else():
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abé"), rng.integers(2, 8))) for _ in range(700)} | {"z" * 40, "z" * 41, "y" + "z" * 40}
    names = sorted(words)
    got = {w: set() for w in names}
    for a, b in spelling.PositionIndex(names).near():
        for x, y in zip(a, b):
            assert names[y] not in got[names[x]]
            got[names[x]].add(names[y])
    assert got == brute_near(names)


@pytest.mark.parametrize("most, together", [(4096, 1024), (40, 7), (5, 1)])
def test_long_lists_are_filed_again_without_losing_a_pair(spark, monkeypatch, most, together):
    monkeypatch.setattr(spelling, "TOGETHER", together)
    rng = np.random.default_rng(2)
    words = {"".join(rng.choice(list("abc"), rng.integers(2, 12))) for _ in range(500)}
    words |= {"common" + w for w in list(words)[:150]} | {w + "ending" for w in list(words)[:150]}
    counts = {w: int(rng.integers(1, 4) * 5 ** rng.integers(0, 5)) for w in words}
    got = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n bigint"), most).collect()
    want = brute_near(counts)
    assert {(r["word"], r["other"], r["other_n"]) for r in got} == {(w, o, counts[o]) for w in want for o in want[w]}
    assert len(got) == sum(map(len, want.values()))
    out = spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n bigint"))
    assert groups(out) == brute_groups(counts)


def test_odd_rows(spark, odd, empty, monkeypatch):
    assert groups(spelling.variant_groups(spelling.count_words(empty, spelling.latin_words()))) == set()
    assert groups(spelling.variant_groups(spelling.count_words(odd, spelling.latin_words()))) == brute_groups(
        brute_counts([(r["doc_id"], r["text"]) for r in odd.collect()]))
    rows = [(i, "Straße naïveté NAÏVETÉ ÉCOLES écoles colour×s Colours colours colour 中文文文文文文 abcdefß") for i in range(900)]
    rows += [(None, "colours colourz"), (7, None), (7, ""), *[(5, "colours colourz")] * 6]
    want = brute_counts(rows)
    monkeypatch.setattr(spelling, "HELD", 3)
    got = spelling.count_words(frame(spark, rows), spelling.latin_words())
    assert {r["word"]: r["n"] for r in got.collect()} == want and "colour" in want and want["colourz"] == 7
    assert groups(spelling.variant_groups(got)) == brute_groups(want)


def test_a_shortened_run_that_equals_another_shortened_run_is_counted_as_it_came():
    """In row 1218 a letter of aaaaaaa goes, and one of aaaaaa too: the first stays a word, the second is too short."""
    words_of = spelling.latin_words()
    for text in ("aaaaaaa aaaaaa", "aaaaaa aaaaaaa", "aaaaaaa AAAAAA aaaaaaa aaaaaa"):
        assert dict(words_of(1218, text)) == brute_counts([(1218, text)], min_count=1) == {"aaaaaa": text.lower().count("aaaaaaa")}
