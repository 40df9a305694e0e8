"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint's 64 bits are the majority bits of its shingles' hashes. Two fingerprints that differ in at most ``d``
bits differ in at most ``d`` of the eight bytes, so they share at least ``8 - d`` positional bytes. The index files
each distinct fingerprint under sets of three positional bytes chosen so that any four shared positions contain one of
the sets (a Turan system: 20 sets for 8 positions). Within a posting list the shared positional bytes of a pair are
tallied, pairs below the guaranteed count are dropped, and the rest is verified by bit distance. A list emits links
that connect what it connects (at most one per fingerprint), never all its pairs; a list longer than ``LONG_LIST`` is
filed again under one more positional byte, and if it is still longer under groups of the bits that are left. Equal
fingerprints are merged first, so copies never meet in a list.

Words are the runs of bytes other than space and 0x09-0x0D after lower-casing A-Z; a shingle is ``words`` of them
joined by spaces, repeats included; a shorter text is one shingle; a text without words (or null) has fingerprint 0 and
links like any other. A row without doc_id links nothing and takes the component of its fingerprint, if any. Extra
columns are ignored, repeated rows count as copies, an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_LOWER, ASCII_UPPER, prepare, stored, text_batches
from tessera.llm.components import components

SEED = 42
POSITIONS = 8
#: A posting list that holds more fingerprints is filed under one more byte instead.
LONG_LIST = 1 << 16
#: Lists up to this size are compared element by element, longer ones by search from one element to the next.
SHORT_LIST = 48
_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


# --- fingerprints ---------------------------------------------------------------------------------------------------

def shingle_hashes(text: str, words: int) -> list[int]:
    from xxhash import xxh64_intdigest
    own = text.encode("utf-8").translate(_LOWER).split()
    joined = b" ".join(own)
    if len(own) <= words:
        return [xxh64_intdigest(joined, SEED)] if own else []
    ends = list(itertools.accumulate(len(w) + 1 for w in own))
    return [xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1:])]


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The majority bits of each group of hashes (a group begins at each of ``starts``; none is empty)."""
    n = np.diff(np.append(starts, len(hashes)))
    # runs of at most 255 hashes: eight 8-bit counters fit side by side into a word
    runs = -(-n // 255)
    first = np.cumsum(runs) - runs
    cut = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    out = np.zeros(len(starts), np.uint64)
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        counted = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, cut)
        per_byte = np.add.reduceat(counted.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):  # little-endian: lane i holds bit 8 * i + bit
            out |= (2 * per_byte[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, most=1 << 20):
            hashes, starts, rows = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = shingle_hashes(text, words) if text else []
                if own:
                    starts.append(len(hashes))
                    rows.append(i)
                    hashes += own
            out = np.zeros(batch.num_rows, np.uint64)
            if rows:
                out[rows] = majority(np.array(hashes, np.uint64), np.array(starts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))],
                                             ["doc_id", "fingerprint"])
    return run


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fingerprint as a signed 64-bit number)."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(_fingerprints(words), "doc_id bigint, fingerprint bigint")


# --- index, count filter, verification ------------------------------------------------------------------------------

def position_sets(n: int = POSITIONS) -> list[tuple[int, ...]]:
    """Triples of positions of which every four positions contain one: three parts in a ring; triples inside a part,
    and two of a part with one of the next."""
    parts = [p.tolist() for p in np.array_split(np.arange(n), 3)]
    out = [t for p in parts for t in itertools.combinations(p, 3)]
    for i, p in enumerate(parts):
        out += [tuple(sorted((*two, x))) for two in itertools.combinations(p, 2) for x in parts[(i + 1) % 3]]
    return out


def near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether pairs share enough positional bytes (the count filter) and then differ in at most ``bits`` bits."""
    diff = a ^ b
    shared = np.zeros(len(diff), np.int8)
    for p in range(POSITIONS):
        shared += (diff >> np.uint64(8 * p)) & np.uint64(255) == 0
    ok = shared >= POSITIONS - bits
    ok[ok] = np.bitwise_count(diff[ok]) <= bits
    return ok


def link_list(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (as places) that join the near values of one posting list: a search that visits each value once and
    compares it with those not yet reached."""
    out, left = [], np.arange(len(values))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            hit = near(values[left], values[at], bits)
            out += [(int(at), int(i)) for i in left[hit]]
            todo.extend(left[hit])
            left = left[~hit]
    return out


def _link(bits: int, whole: bool):
    """Links of the lists in rows sorted by list; rows of lists over ``LONG_LIST`` come back as they are (b null)
    unless ``whole``."""
    names = ["a", "b", "list", "fingerprint"]

    def finish(keys, values, nodes):
        edge = np.flatnonzero(np.diff(keys)) + 1
        starts, sizes = np.append(0, edge), np.diff(np.concatenate([[0], edge, [len(keys)]]))
        a, b = [], []
        run = np.repeat(np.arange(len(sizes)), sizes)
        short = np.flatnonzero((sizes > 1) & (sizes <= SHORT_LIST))
        if len(short):
            rows = np.flatnonzero(np.isin(run, short))
            for step in range(1, int(sizes[short].max())):
                rows = rows[rows + step < len(run)]
                rows = rows[run[rows + step] == run[rows]]
                hit = rows[near(values[rows], values[rows + step], bits)]
                a.append(nodes[hit])
                b.append(nodes[hit + step])
        for i in np.flatnonzero(sizes > SHORT_LIST):
            own = slice(starts[i], starts[i] + sizes[i])
            links = np.array(link_list(values[own], bits), np.int64).reshape(-1, 2)
            a.append(nodes[own][links[:, 0]])
            b.append(nodes[own][links[:, 1]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        nothing = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), nothing, nothing], names)

    def over(keys, values, nodes):
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.int64()), pa.array(keys),
                                           pa.array(values.view(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        long_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(c).to_numpy() for c in ("list", "fingerprint", "node"))
            now = (now[0], now[1].view(np.uint64), now[2])
            if long_key is not None:
                same = int(np.searchsorted(now[0], long_key, side="right"))
                if same:
                    yield over(*(x[:same] for x in now))
                now = tuple(x[same:] for x in now)
                if not len(now[0]):
                    continue
                long_key = None
            held.append(now)
            keys, values, nodes = (np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            if last:
                yield finish(keys[:last], values[:last], nodes[:last])
            held = [(keys[last:], values[last:], nodes[last:])]
            if len(held[0][0]) > LONG_LIST and not whole:
                yield over(*held[0])
                held, long_key = [], keys[-1]
        if held:
            yield finish(*(np.concatenate(x) for x in zip(*held)))
    return run


def _filed(rows: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(list, fingerprint, node): a row per set of positions; the list's number mixes the set and its bytes."""
    def byte(p: int):
        return F.shiftrightunsigned("fingerprint", 8 * p).bitwiseAND(F.lit(255))

    lists = []
    for i, s in enumerate(sets):
        key = F.lit(i).cast("long")
        for p in s:
            key = key * 256 + byte(p)
        lists.append(key)
    return rows.select(F.explode(F.array(*lists)).alias("list"), "fingerprint", "node")


def _filed_by_rest(rows: DataFrame, sets: list[tuple[int, ...]], bits: int) -> DataFrame:
    """(list, fingerprint, node) for rows of lists under four positions: the 32 bits at the other positions are cut into
    one group more than bits may differ, so two near fingerprints of a list agree in a whole group; each row is filed
    under its list and each of its groups."""
    shifts = F.array(*[F.array(*[F.lit(8 * p) for p in range(POSITIONS) if p not in s]) for s in sets])
    own = F.element_at(shifts, F.shiftrightunsigned("list", 32).cast("int") + 1)
    rest = F.lit(0).cast("long")
    for j in range(4):
        byte = F.call_function("shiftrightunsigned", F.col("fingerprint"), own[j]).bitwiseAND(F.lit(255))
        rest = rest + byte * (1 << 8 * j)
    edges = [32 * i // (bits + 1) for i in range(bits + 2)]
    lists = [F.xxhash64("list", F.lit(i), F.shiftrightunsigned("rest", lo).bitwiseAND(F.lit((1 << hi - lo) - 1)))
             for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    return (rows.withColumn("rest", rest)
            .select(F.explode(F.array(*lists)).alias("list"), "fingerprint", F.col("a").alias("node")))


def links(nodes: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) between the nodes (fingerprint, node) at most ``bits`` apart, enough to connect them."""
    if not 0 <= bits <= 4:
        raise ValueError("the sets of positions guarantee links up to 4 differing bits")
    sets = position_sets()

    def linked(filed: DataFrame, whole: bool) -> DataFrame:
        dealt = filed.repartition("list").sortWithinPartitions("list", "fingerprint")
        return stored(dealt.mapInArrow(_link(bits, whole), "a bigint, b bigint, list bigint, fingerprint bigint"),
                      "links")

    first = linked(_filed(nodes, sets), whole=False)
    out, long_lists = first.where("b is not null"), first.where("b is null")
    if not long_lists.isEmpty():
        # every four shared positions that hold a set: the set and one position more
        wider = sorted({tuple(sorted((*s, p))) for s in sets for p in range(POSITIONS) if p not in s})
        again = long_lists.select("fingerprint", F.col("a").alias("node")).distinct()
        second = linked(_filed(again, wider), whole=False)
        out, long_lists = out.union(second.where("b is not null")), second.where("b is null")
        if not long_lists.isEmpty():
            out = out.union(linked(_filed_by_rest(long_lists, wider, bits), whole=True).where("b is not null"))
    return out.select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (signed 64-bit), component_id (smallest doc_id it is linked to,
    through any chain of links)."""
    marked = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(marked.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("node")),
                   "fingerprint-nodes")
    joined = components(links(nodes, bits))
    of = nodes.join(joined, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return marked.join(of, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")
