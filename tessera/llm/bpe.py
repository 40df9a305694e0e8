"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that can end a valid encoding of that prefix; storing it
for each byte gives the encoding by walking back, and appending bytes only adds entries. A token may follow another if
undoing their merges never shows a pair across the seam that would have merged earlier. The result equals merging the
lowest rank first. Pieces (matches of the split pattern) are independent, so a text is re-encoded near an edit only.

Null texts count as empty; empty texts have no ids; repeated rows are encoded each; extra columns are ignored.

Rows are told apart as rows: those that share an id, and rows without one, each have a result of their own.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import HASH_BASE, MIX_2, mix64, prepare, text_batches

#: Pieces, and stretches between spaces, remembered per worker in each of two generations.
CACHE_ENTRIES = 250_000
#: Token pairs whose validity is remembered per worker.
PAIR_ENTRIES = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixBpe:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {n: t for t, n in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._split_tokens()

    def _split_tokens(self) -> None:
        """The last merge that forms each token, in rank order. Tokens that merging never forms have none; they stand
        only for a whole piece."""
        self.reachable: dict[bytes, int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: (len(x[0]) > 1, x[1])):
            if len(token) == 1:
                self.halves[rank] = None
                self.reachable[token] = rank
                continue
            parts = self._merge(token, rank)
            if len(parts) == 2:
                self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
                self.reachable[token] = rank

    def _merge(self, piece: bytes, below: int) -> list[bytes]:
        """Merge ``piece`` lowest rank first, with ranks under ``below`` only."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand after ``left``: the seam between them must survive. The merges that formed the
        two tokens are undone from the latest to the earliest; a pair across the seam that is itself a token of lower
        rank than the merge just undone would have been taken first."""
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        if len(self.pairs) >= PAIR_ENTRIES:
            self.pairs.clear()
        ok = self.pairs[left, right] = self._seam_survives(left, right)
        return ok

    def _seam_survives(self, a: int, b: int) -> bool:
        bytes_of, ranks, halves = self.bytes_of, self.ranks, self.halves
        # merging the seam at rank r beats the other merges if r is lower; among equal ranks the leftmost pair goes
        # first, so the seam wins against a merge to its right and loses against one to its left
        before = 1 << 60
        ties_win = False
        while True:
            seam = ranks.get(bytes_of[a] + bytes_of[b])
            if seam is not None and (seam < before or ties_win and seam == before):
                return False
            in_a, in_b = halves[a], halves[b]
            if in_a is None and in_b is None:
                return True
            # the later of the two merges is undone: the higher rank; for equal ranks the one to the right
            if in_b is None or in_a is not None and a > b:
                before, ties_win, a = a, False, in_a[1]
            else:
                before, ties_win, b = b, True, in_b[0]

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of the valid encoding of each prefix (entry i: of ``piece[:i + 1]``). ``known``: the entries
        of a prefix of ``piece``, which stay as they are."""
        out = list(known or ())
        reachable, pairs, longest = self.reachable, self.pairs, self.longest
        for end in range(len(out) + 1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = reachable.get(piece[start:end])
                if token is None:
                    continue
                if not start:
                    out.append(token)
                    break
                left = out[start - 1]
                ok = pairs.get((left, token))
                if self.follows(left, token) if ok is None else ok:
                    out.append(token)
                    break
        return out

    def walk_back(self, last: list[int]) -> list[int]:
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk_back(self.last_tokens(piece))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class BatchBpe:
    """The same prefix table for many pieces at a time: entry i of all pieces is found together, longest token first.

    Substrings are compared with the tokens by 64-bit prefix hashes, behind a small filter; remembered token pairs lie in
    a direct-mapped table, and pairs not in it are asked of ``PrefixBpe.follows``. Pieces over ``WIDE`` bytes take the
    one-piece form."""

    WIDE, FILTER_BITS, PAIR_BITS = 32, 20, 20

    def __init__(self, bpe: PrefixBpe):
        self.bpe = bpe
        tokens = [(t, n) for t, n in bpe.reachable.items() if len(t) <= self.WIDE]
        powers = [1]
        for _ in range(self.WIDE):
            powers.append(powers[-1] * HASH_BASE % 2 ** 64)
        self.powers = np.array(powers, np.uint64)
        keys = np.concatenate([self._key(self._prefixes(self._bytes([t for t, _ in own], size))[:, size], size)
                               for size, own in _by_size(tokens)])
        ids = np.array([n for _, own in _by_size(tokens) for _, n in own], np.int64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.filter = np.zeros(1 << self.FILTER_BITS, bool)
        self.filter[(keys >> np.uint64(64 - self.FILTER_BITS)).astype(np.int64)] = True
        self.length = np.zeros(max(bpe.bytes_of) + 1, np.int64)
        for n, t in bpe.bytes_of.items():
            self.length[n] = len(t)
        self.longest = max((len(t) for t, _ in tokens), default=1)
        self.pair_key = np.full(1 << self.PAIR_BITS, -1, np.int64)
        self.pair_ok = np.zeros(1 << self.PAIR_BITS, bool)

    @staticmethod
    def _bytes(pieces: list[bytes], width: int) -> np.ndarray:
        return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)

    def _prefixes(self, raw: np.ndarray) -> np.ndarray:
        """Hash of each prefix: column i is that of the first i bytes."""
        out = np.zeros((len(raw), raw.shape[1] + 1), np.uint64)
        for i in range(raw.shape[1]):
            out[:, i + 1] = out[:, i] * self.powers[1] + raw[:, i] + np.uint64(1)
        return out

    @staticmethod
    def _key(hashes: np.ndarray, size: int) -> np.ndarray:
        return mix64(hashes + np.uint64(size * MIX_2 % 2 ** 64))

    def _follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        slot = (mix64(key.astype(np.uint64)) >> np.uint64(64 - self.PAIR_BITS)).astype(np.int64)
        miss = np.flatnonzero(self.pair_key[slot] != key)
        out = self.pair_ok[slot]
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            ok = np.array([self.bpe._seam_survives(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)
            out[miss] = ok[back]
            self.pair_key[slot[miss]], self.pair_ok[slot[miss]] = key[miss], out[miss]
        return out

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        some = []
        for i, p in enumerate(pieces):
            whole = self.bpe.ranks.get(p)
            if whole is not None:
                out[i] = [whole]
            elif len(p) > self.WIDE:
                out[i] = self.bpe.encode_piece(p)
            else:
                some.append(i)
        some.sort(key=lambda i: -len(pieces[i]))
        if some:
            for i, ids in zip(some, self._table([pieces[i] for i in some])):
                out[i] = ids
        return out

    def _table(self, pieces: list[bytes]) -> list[list[int]]:
        """Encodings of ``pieces``, longest first."""
        size = np.array([len(p) for p in pieces])
        width = int(size[0])
        prefix = np.asfortranarray(self._prefixes(self._bytes(pieces, width)))
        last = np.zeros((len(pieces), width), np.int64, order="F")
        for end in range(1, width + 1):
            open_ = np.arange(np.searchsorted(-size, -end, side="right"))
            for n in range(min(end, self.longest), 0, -1):
                start = end - n
                key = self._key(prefix[open_, end] - prefix[open_, start] * self.powers[n], n)
                maybe = np.flatnonzero(self.filter[(key >> np.uint64(64 - self.FILTER_BITS)).astype(np.int64)])
                if not len(maybe):
                    continue
                at = np.searchsorted(self.keys, key[maybe])
                at[at == len(self.keys)] = 0
                hit = self.keys[at] == key[maybe]
                rows, token = open_[maybe[hit]], self.ids[at[hit]]
                if start and len(rows):
                    ok = self._follows(last[rows, start - 1], token)
                    rows, token = rows[ok], token[ok]
                last[rows, end - 1] = token
                if len(rows):
                    open_ = np.setdiff1d(open_, rows, assume_unique=True)
                    if not len(open_):
                        break
        # back from the end, all pieces a token at a time
        at, rows, steps = size.copy(), np.arange(len(pieces)), []
        while len(rows):
            token = last[rows, at[rows] - 1]
            steps.append((rows, token))
            at[rows] -= self.length[token]
            rows = rows[at[rows] > 0]
        owner = np.concatenate([r for r, _ in steps[::-1]])
        token = np.concatenate([t for _, t in steps[::-1]])
        order = np.argsort(owner, kind="stable")
        token, cut = token[order].tolist(), np.searchsorted(owner[order], np.arange(len(pieces) + 1)).tolist()
        return [token[a:b] for a, b in zip(cut, cut[1:])]


def _by_size(tokens: list[tuple[bytes, int]]) -> list[tuple[int, list[tuple[bytes, int]]]]:
    groups: dict[int, list] = {}
    for t, n in tokens:
        groups.setdefault(len(t), []).append((t, n))
    return sorted(groups.items())


class AppendableText:
    """The encoding of a growing or edited text: pieces before the place of a change keep their ids, and the last piece
    keeps its prefix entries when bytes are appended to it."""

    def __init__(self, bpe: PrefixBpe, pattern: str, text: str = ""):
        import regex
        self.bpe, self.pattern = bpe, regex.compile(pattern)
        self.text = ""
        self.pieces: list[tuple[int, str, list[int]]] = []  # start, piece, last token per byte
        self.edit(0, 0, text)

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace ``text[start:end]`` by ``new``; returns how many pieces were split anew. The pattern looks one
        character past a piece, so splitting restarts one piece before the change and stops where a piece begins at
        the same place of the unchanged rest, beyond the change, as before."""
        before = self.text
        self.text = before[:start] + new + before[end:]
        shift = len(self.text) - len(before)
        old = {at + shift: i for i, (at, _, _) in enumerate(self.pieces) if at >= end}
        keep = next((i for i, (at, piece, _) in enumerate(self.pieces) if at + len(piece) >= start), len(self.pieces))
        keep = max(0, keep - 1)
        head, rest = self.pieces[:keep], self.pieces[keep:]
        at, fresh = (head[-1][0] + len(head[-1][1]) if head else 0), []
        settled = start + len(new)
        entries = {a: (p, last) for a, p, last in rest}
        while at < len(self.text):
            if at > settled and at in old:
                tail = self.pieces[old[at]:]
                self.pieces = head + fresh + [(a + shift, p, last) for a, p, last in tail]
                return len(fresh)
            piece = self.pattern.match(self.text, at).group()
            was, last = entries.get(at, ("", []))
            same = 0
            for x, y in zip(piece, was):
                if x != y:
                    break
                same += 1
            kept = last[:len(piece[:same].encode())]
            fresh.append((at, piece, self.bpe.last_tokens(piece.encode(), kept)))
            at += len(piece)
        self.pieces = head + fresh
        return len(fresh)

    def ids(self) -> list[int]:
        out: list[int] = []
        for _, piece, last in self.pieces:
            whole = self.bpe.ranks.get(piece.encode())
            out += [whole] if whole is not None else self.bpe.walk_back(last)
        return out


class _Remembered:
    """Results by argument, in two generations of at most ``CACHE_ENTRIES`` new ones each."""

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def of(self, keys: set) -> dict:
        """A result for every key (and maybe more); ``make`` is asked for those not remembered, all at once."""
        missing = keys - self.young.keys()
        if len(self.young) + len(missing) > CACHE_ENTRIES:
            # the results in use now stay with the young ones
            self.old, self.young = self.young, {k: self.young[k] for k in keys - missing}
        young, old = self.young, self.old
        fresh = []
        for k in missing:
            v = old.get(k)
            if v is None:
                fresh.append(k)
            else:
                young[k] = v
        young.update(zip(fresh, self.make(fresh)))
        return young


class _Coder:
    """(ids, their decimal text, decoded bytes) for stretches of text that the split pattern never joins. With the public
    pattern a space that has a non-space on one side begins a new match, so texts are cut at spaces first; repeated
    stretches and pieces are remembered, and what is new in a batch is encoded together."""

    def __init__(self, path: str, pattern: str):
        import public_tokenizers
        import regex
        self.bpe, self.split = PrefixBpe(read_ranks(path)), regex.compile(pattern)
        batch = BatchBpe(self.bpe)
        decimal = {n: str(n) for n in self.bpe.bytes_of}

        def coded(pieces: list[str]) -> list[tuple]:
            out, raw = [], [p.encode("utf-8") for p in pieces]
            for p, ids in zip(raw, batch.encode(raw)):
                back = self.bpe.decode(ids)
                if back != p:  # two byte strings met in one hash: this piece by exact look-ups
                    ids = self.bpe.encode_piece(p)
                    back = self.bpe.decode(ids)
                out.append((len(ids), ",".join([decimal[n] for n in ids]), back))
            return out
        self.pieces = _Remembered(coded)
        self.stretches = _Remembered(self._stretches)
        self.at_spaces = pattern == public_tokenizers.PATTERN
        self.joined, self.open_end = regex.compile(r"\s \s"), regex.compile(r"\s\s")

    def _cut(self, stretch: str) -> list[str]:
        """The pattern's matches. A stretch that begins with a space is the first of its text and has none before it;
        the others have one. A space and letters, or these and one mark that is no apostrophe, need no pattern."""
        if stretch[:1] == " ":
            return self.split.findall(stretch[1:])
        if self.at_spaces:
            if stretch.isalpha():
                return [" " + stretch]
            if stretch[-1:] in _MARKS and stretch[:-1].isalpha():
                return [" " + stretch[:-1], stretch[-1]]
        return self.split.findall(" " + stretch)

    def _stretches(self, stretches: list[str]) -> list[tuple]:
        cut = [self._cut(x) for x in stretches]
        known = self.pieces.of(set(itertools.chain.from_iterable(cut)))
        out = []
        for own in cut:
            if len(own) == 1:
                out.append(known[own[0]])
            else:
                got = [known[p] for p in own]
                out.append((sum(x[0] for x in got), ",".join([x[1] for x in got]), b"".join([x[2] for x in got])))
        return out

    def code(self, texts: list[str]) -> list[list[tuple]]:
        """Per text its stretches' results in order."""
        # white space at the end of a text is one match however it is cut
        plain = [self.at_spaces and not self.joined.search(t) and not self.open_end.fullmatch(t[-2:]) for t in texts]
        cut = [t.split(" ") if ok else self.split.findall(t) for t, ok in zip(texts, plain)]
        for own, ok in zip(cut, plain):
            if ok:
                own[0] = " " + own[0]
            else:
                own[:] = [" " + p for p in own]
        known = self.stretches.of(set().union(*cut))
        return [list(map(known.__getitem__, own)) for own in cut]


_MARKS = frozenset(".,;:!?")
_state: dict[tuple[str, str], _Coder] = {}


def _coded(path: str, pattern: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, pattern) not in _state:
            _state[path, pattern] = _Coder(path, pattern)
        coder = _state[path, pattern]
        for batch in text_batches(batches, most=4 << 20):
            counts, ids, texts = [], [], []
            for own in coder.code([t or "" for t in batch.column("text").to_pylist()]):
                counts.append(sum([x[0] for x in own]))
                ids.append(hashlib.sha256(",".join([x[1] for x in own if x[0]]).encode()).hexdigest())
                texts.append(hashlib.sha256(b"".join([x[2] for x in own])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the remembered results hold no cycles; searching them for some costs a fifth of the time
        gc.disable()
        try:
            yield from rows(batches)
        finally:
            gc.enable()
    return run


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        bpe, split = PrefixBpe(read_ranks(path)), regex.compile(pattern)
        for batch in text_batches(batches, most=2 << 20):
            ids = [[n for p in split.findall(t or "") for n in bpe.encode_piece(p.encode())]
                   for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))],
                                             ["doc_id", "ids"])
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of whole texts."""
    prepare(docs.sparkSession)
    return _narrow(docs).mapInArrow(_ids(ranks_path, pattern), "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode and decode whole texts: doc_id, n_tokens, digest of the ids, digest of the decoded bytes."""
    prepare(docs.sparkSession)
    return _narrow(docs).mapInArrow(_coded(ranks_path, pattern),
                                    "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
