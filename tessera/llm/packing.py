"""Pack tokenised documents into sequences of at most ``CAPACITY`` tokens.

A document's ids end with one separator id; longer ones are cut into pieces of the capacity, the first piece taking
the remainder. Only the histogram of piece lengths (at most ``CAPACITY`` counts, whatever the input) is planned on the
driver: patterns of two or three length classes that can fill a sequence are enumerated, their repeat counts fitted
to the histogram by non-negative least squares, rounded down and turned into patterns of exact lengths; what is left is
packed longest first into the smallest gap that takes it, or into new sequences. The plan says, per length, which ranks go to
which pattern; pieces are ranked within their length and placed without meeting in one task.

A null text is empty (its document is the separator alone); repeated rows are packed as separate documents by
``doc_id``; an empty table gives no rows.

Rows are told apart as rows: those that share an id, and rows without one, each have a result of their own.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered, prepare, stored, text_batches

CAPACITY = 2048
#: Width in tokens of a length class while patterns are fitted.
CLASS_WIDTH = 16


# --- tokens ---------------------------------------------------------------------------------------------------------

class TextEncoder:
    """Ids of whole texts as little-endian uint32 bytes, as the ``tokenizers`` library gives them.

    A byte-level BPE file is also loaded as merge ranks into ``tiktoken``, which applies the same merges about three
    times faster. ``tokenizers`` stays the authority: it encodes the first text of every batch and every text that
    holds the string of a special token, and the whole batch if the two ever disagree."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = _merge_ranks(json.loads(self.tokenizer.to_str()))
        if ranks:
            import public_tokenizers
            import tiktoken
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})

    def _slow(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.fast is None or not texts:
            return self._slow(texts)
        out = [b"" if any(x in t for x in self.special) else np.array(self.fast.encode_ordinary(t), "<u4").tobytes()
               for t in texts]
        asked = [i for i, t in enumerate(texts) if not i or any(x in t for x in self.special)]
        for i, ids in zip(asked, self._slow([texts[i] for i in asked])):
            if out[i] and out[i] != ids:
                return self._slow(texts)
            out[i] = ids
        return out


def _merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes -> id of a byte-level BPE whose ids follow the order of its merges; None for any other tokenizer."""
    split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if (split.get("type"), split.get("add_prefix_space"), split.get("use_regex"), spec.get("normalizer"),
            model.get("type")) != ("ByteLevel", False, True, None, "BPE"):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [model["vocab"].get(a + b, -1) for a, b in pairs]
    letters = {c: b for b, c in _byte_letters().items()}
    if merged != sorted(merged) or not all(c in model["vocab"] for c in letters):
        return None
    return {bytes(letters[c] for c in word): n for word, n in model["vocab"].items() if set(word) <= letters.keys()}


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1 bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_encoders: dict[str, TextEncoder] = {}


def _pieces(path: str, capacity: int, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = TextEncoder(path)
        encoder = _encoders[path]
        end = np.asarray([separator], "<u4").tobytes()
        for batch in text_batches(batches, most=2 << 20):
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            rows: list[tuple] = []
            for doc, own in zip(batch.column("doc_id").to_pylist(), ids):
                own += end
                n = len(own) // 4
                first = n % capacity or capacity
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    to = first if not piece else start + capacity
                    rows.append((doc, piece, start, to - start, zlib.crc32(own[4 * start:4 * to])))
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _pieces(tokenizer_path, capacity, separator),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


# --- the plan, from the histogram alone -----------------------------------------------------------------------------

def class_patterns(classes: int, present: list[int]) -> list[tuple[int, ...]]:
    """Patterns of one to three length classes (class c holds the lengths above (c - 1) and up to c widths) that can
    fill a sequence of ``classes`` widths to the last token."""
    have, out = set(present), []
    for a in present:
        for b in present:
            if b > a:
                break
            if a + b in (classes, classes + 1):
                out.append((a, b))
            for total in (classes, classes + 1, classes + 2):
                c = total - a - b
                if 0 < c <= b and c in have:
                    out.append((a, b, c))
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by active sets: the column with the steepest gain joins, the columns that would turn
    negative leave."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gain = a.T @ b
    for _ in range(rounds):
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[j] = True
        while True:
            idx = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[idx] = s
                break
            bad = s <= 0
            step = np.min(x[idx][bad] / np.maximum(x[idx][bad] - s[bad], 1e-300))
            x[idx] += step * (s - x[idx])
            active[idx[(x[idx] <= 1e-12) & bad]] = False
            x[~active] = 0
            if not active.any():
                break
        gain = a.T @ (b - a @ x)
    return x


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for ``counts`` (length -> pieces) as (lengths, repeats): every piece is placed exactly once."""
    left = {n: c for n, c in counts.items() if c > 0}
    done: dict[tuple[int, ...], int] = defaultdict(int)
    if capacity in left:
        done[(capacity,)] = left.pop(capacity)
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for lengths, n in _fitted(left, capacity):
        gap = capacity - sum(lengths)
        open_[gap][lengths] = open_[gap].get(lengths, 0) + n
    # residuals, longest first, each into the smallest gap that takes it
    gaps = sorted(open_)
    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            at = bisect.bisect_left(gaps, n)
            if at < len(gaps):
                gap = gaps[at]
                lengths, have = next(iter(open_[gap].items()))
                per, used = 1, min(have, todo)
                del open_[gap][lengths]
                if have > used:
                    open_[gap][lengths] = have - used
                elif not open_[gap]:
                    gaps.pop(at)
            else:  # as many copies as fit share a new sequence
                gap, lengths = capacity, ()
                per = min(capacity // n, todo)
                used = todo // per
            smaller = gap - n * per
            if not open_[smaller]:
                bisect.insort(gaps, smaller)
            key = (*lengths, *[n] * per)
            open_[smaller][key] = open_[smaller].get(key, 0) + used
            todo -= used * per
    for group in open_.values():
        for lengths, n in group.items():
            done[lengths] += n
    return sorted(done.items(), reverse=True)


def _fitted(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fit class patterns to ``left``, turn their repeats into exact lengths that fill a sequence to the last token,
    and take what they use out of ``left``."""
    classes = capacity // CLASS_WIDTH

    def of(n: int) -> int:
        return -(-n // CLASS_WIDTH)

    members: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left):
        members[of(n)].append(n)
    present = sorted(members)
    patterns = class_patterns(classes, present) if capacity % CLASS_WIDTH == 0 else []
    if not patterns:
        return []
    row = {c: i for i, c in enumerate(present)}
    a, b = np.zeros((len(present), len(patterns))), np.zeros(len(present))
    for n, c in left.items():
        b[row[of(n)]] += c
    for j, p in enumerate(patterns):
        for c in p:
            a[row[c], j] += 1
    repeats = np.floor(nnls(a, b) + 1e-9).astype(np.int64)
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for j in np.argsort(-repeats, kind="stable"):
        todo = int(repeats[j])
        if not todo:
            break
        *free, last = patterns[j]
        for lengths in itertools.product(*(members[c] for c in free)):
            rest = capacity - sum(lengths)
            if todo and rest > 0 and of(rest) == last:
                need = Counter((*lengths, rest))
                n = min([todo, *(left.get(x, 0) // m for x, m in need.items())])
                if n:
                    for x, m in need.items():
                        left[x] -= n * m
                    out[(*lengths, rest)] += n
                    todo -= n
    for x in [x for x, n in left.items() if not n]:
        del left[x]
    return list(out.items())


def placement(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """The plan as ranges of ranks per length: arrays (key of length and first rank, first rank, first sequence,
    offset), sorted by key."""
    used: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for lengths, n in plan:
        offset = 0
        for x in lengths:
            rows.append(((x << 44) + used[x], used[x], first, offset))
            used[x] += n
            offset += x
        first += n
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(4))


def _place(arrays):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, firsts, offsets = arrays.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (n << 44) + rank, side="right") - 1
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(
                cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer_path, capacity, separator)
                    .withColumn("key", F.concat_ws("-", "doc_id", "piece")), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    arrays = spark.sparkContext.broadcast(placement(pack_histogram(counts, capacity)))
    ranked = numbered(pieces, ["length"], "key", "rank")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _place(arrays), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, "
        "offset bigint")
