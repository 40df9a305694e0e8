"""Spelling variants: words of a corpus that are one edit from a far more frequent word, through a bit-sliced position index.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced code point turns one into the
other. For a set of words the index holds one bitset per (position, letter): bit w is set if word w has that letter there.
A word is matched against the whole set letter by letter, 64 words per machine word, with four running sets: words that
agree so far without an error, and words that agree with one error, whose remaining letters stand at the same place (a
replaced letter), one place further (an inserted letter) or one place earlier (a deleted letter), so that the next letter is
looked up at the shifted position. What is left at the end, with the length that belongs to each set, is what is near. The
words asked about are matched side by side, those of one length at a time.

The vocabulary is divided without losing a pair: one edit leaves either the first or the last half of the shorter word
intact, so each word is filed under its halves (for its own length as the shorter and as the longer word). A list with
more than ``LIST`` words is filed again by the halves of what remains of its words, which one edit leaves intact in the
same way, until at most ``REST`` letters remain; no list has to be taken in part or compared pair by pair. Tasks read their
lists in order and put small ones together into one index.

A word's form is its most frequent near word (ties: the first in code-point order) if that is at least ``ratio`` times as
frequent; following forms ends at its root. Null texts have no words, texts are read whole; repeated rows count as often as
they stand there. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare, stored, text_batches

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: Words of a list that is not filed again, letters that are not divided again, words put into one index.
LIST, REST, TOGETHER = 4096, 3, 1024
#: Different words whose counts a task holds before it hands them on.
HELD = 200_000
#: Machine words per running set while words are matched side by side.
SIDE_BY_SIDE = 1 << 15


# --- counting words --------------------------------------------------------------------------------------------------

def count_words(docs: DataFrame, words_of: Callable[[int | None, str], Counter], min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that ``words_of`` (doc_id, text) counts, with at least ``min_count`` over all rows; stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in text_batches(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held.update(words_of(doc_id, text))
                if len(held) >= HELD:
                    yield _counts(held)
                    held.clear()
        yield _counts(held)
    prepare(docs.sparkSession)
    own = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = own.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counts.where(F.col("n") >= min_count), "words")


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def latin_words(least: int = MIN_LETTERS, every: int = 199) -> Callable[[int | None, str], Counter]:
    """Counts the maximal runs of Latin letters (A-Z lower-cased) that keep at least ``least`` letters; in a run whose
    crc32 of ``<doc_id>:<run>`` is divisible by ``every`` one letter, chosen by that number, is left out first. A row
    without id keeps its runs as they are."""
    runs = re.compile(rf"[a-zÀ-ÿ]{{{least},}}")

    def words_of(doc_id: int | None, text: str) -> Counter:
        found = Counter(runs.findall(text.encode().translate(_LOWER).decode()))
        if doc_id is None:
            return found
        start = zlib.crc32(b"%d:" % doc_id)
        # all of them go before any comes back: a shortened run may be one that is shortened itself
        shortened = [(w, found.pop(w)) for w in list(found) if not zlib.crc32(w.encode(), start) % every]
        for run, n in shortened:
            at = zlib.crc32(run.encode(), start) % len(run)
            if len(run) > least:
                found[run[:at] + run[at + 1:]] += n
        return found
    return words_of


# --- the bit-sliced index --------------------------------------------------------------------------------------------

def letter_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (word x position, 0 beyond the end) and lengths."""
    sizes = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    _, codes = np.unique(points, return_inverse=True)
    out = np.zeros((len(words), int(sizes.max(initial=0)) + 2), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = codes.ravel() + 1
    return out, sizes


class PositionIndex:
    """Bitsets over ``words``: ``bits[p, c]`` holds the words with letter c (0: none) at position p."""

    def __init__(self, words: list[str]):
        self.codes, self.sizes = letter_codes(words)
        self.width = -(-len(words) // 64)
        letters = int(self.codes.max(initial=0)) + 1
        self.bits = np.zeros((self.codes.shape[1], letters, self.width), np.uint64)
        words_at = np.arange(len(words))
        for p in range(self.codes.shape[1]):
            np.bitwise_or.at(self.bits[p], (self.codes[:, p], words_at >> 6), np.uint64(1) << (words_at & 63).astype(np.uint64))
        self.of_size = {int(n): self._set(self.sizes == n) for n in np.unique(self.sizes)}

    def _set(self, member: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width * 64, bool)
        out[:len(member)] = member
        return np.packbits(out, bitorder="little").view(np.uint64)

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of words, places of words near them), each pair in both directions."""
        none = np.zeros(self.width, np.uint64)
        step = max(1, SIDE_BY_SIDE // self.width)
        for size in self.of_size:
            own = np.flatnonzero(self.sizes == size)
            for lo in range(0, len(own), step):
                asked = own[lo:lo + step]
                exact = np.broadcast_to(~none, (len(asked), self.width))
                replaced = inserted = deleted = np.broadcast_to(none, exact.shape)
                for i in range(size):
                    letter = self.codes[asked, i]
                    here, further = self.bits[i, letter], self.bits[i + 1, letter]
                    earlier = self.bits[i - 1, letter] if i else none
                    # the letter asked about agrees where it is looked up; or this is where the one error is
                    replaced = (replaced & here) | (exact & ~here & ~self.bits[i, 0])
                    inserted = (inserted | exact) & further
                    deleted = (deleted & earlier) | exact
                    exact = exact & here
                inserted = inserted | exact
                found = ((replaced & self.of_size[size]) | (inserted & self.of_size.get(size + 1, none))
                         | (deleted & self.of_size.get(size - 1, none)))
                pairs = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")
                row, other = np.nonzero(pairs)
                yield asked[row], other


def _near_in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, word, n) sorted by key: the near pairs of the lists, whole lists at a time."""
    held: dict[str, int] = {}
    last = None

    def pairs() -> Iterator[pa.RecordBatch]:
        words = sorted(held)
        counts = np.array([held[w] for w in words], np.int64)
        names = pa.array(words, pa.string())
        for a, b in PositionIndex(words).near():
            if len(a):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(counts[b])],
                                                 ["word", "other", "other_n"])
    for batch in batches:
        for key, word, n in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n"))):
            if key != last and len(held) >= TOGETHER:
                yield from pairs()
                held.clear()
            held[word], last = n, key
    if held:
        yield from pairs()


def _filed(entries: DataFrame) -> DataFrame:
    """(key, word, n, rest): each entry under the halves of its rest. As the shorter of two words a rest of L letters keeps
    its first or last floor(L / 2) letters through the edit, as the longer one floor((L - 1) / 2)."""
    size = F.length("rest")

    def halves(h):
        return [F.struct(F.concat(F.lit("<"), h.cast("string"), F.lit(":"), F.substring("rest", F.lit(1), h)).alias("half"),
                         F.substring("rest", h + 1, size).alias("rest")),
                F.struct(F.concat(F.lit(">"), h.cast("string"), F.lit(":"), F.substring("rest", size - h + 1, h)).alias("half"),
                         F.substring("rest", F.lit(1), size - h).alias("rest"))]
    shorter, longer = F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")
    files = F.array_distinct(F.array(*halves(shorter), *halves(longer)))
    return (entries.select("key", "word", "n", F.explode(files).alias("file"))
            .select(F.concat("key", "file.half").alias("key"), "word", "n", F.col("file.rest").alias("rest")))


def near_words(words: DataFrame, most: int = LIST) -> DataFrame:
    """(word, other, other_n): the near pairs of ``words`` (word, n; distinct words of two letters at least), each in both
    directions and once; stored."""
    entries, done = words.select(F.lit("").alias("key"), "word", "n", F.col("word").alias("rest")), []
    while True:
        entries = stored(_filed(entries), "word-lists")
        sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        long_lists = stored(sizes.where(F.col("c") > most).select("key"), "long-lists")
        divided = F.length("rest") > REST
        long_rows = entries.join(long_lists, "key", "left_semi").where(divided)
        if not long_rows.take(1):
            done.append(entries)
            break
        # what is divided again is compared with the rest of its list below; the others stay where they are
        done.append(entries.join(long_lists, "key", "left_anti")
                    .union(entries.join(long_lists, "key", "left_semi").where(F.length("rest") <= REST + 1)))
        entries = long_rows
    lists = done[0]
    for more in done[1:]:
        lists = lists.union(more)
    found = (lists.select("key", "word", "n").repartition("key").sortWithinPartitions("key")
             .mapInArrow(_near_in_lists, "word string, other string, other_n bigint"))
    return stored(found.distinct(), "near-words")


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n)."""
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    judged = stored(
        words.join(near, "word", "left")
        .withColumn("likely", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(F.col("likely"), F.col("best.form")).alias("form"),
                F.when(F.col("likely"), -F.col("best.less")).alias("form_n")), "word-forms")
    # every step halves the way to the root; a form is at least ratio times as frequent, so the way is short
    ways = stored(judged.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                             F.col("next").isNotNull().alias("moved")), "roots")
        ways = longer.select("word", "root")
        if not longer.where("moved").take(1):
            break
    return judged.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                                                    "form_n")
