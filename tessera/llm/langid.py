"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded sample of labelled text. A text is parsed against it into
phrases, each the longest match that the sample holds from there on; text of the same language needs fewer, longer
phrases. The language with the fewest normalised phrases (phrases times log2 of the sample size) wins.

Every letter of a language's sample has a code in its automaton. With up to ``ALPHABET`` letters the automaton is stored
as one flat table: the next state for each state and letter, or, where a match ends, the state that the letter begins a
new phrase with and a mark that counts the ended one. With more letters the rows of that table, nearly empty, are laid
over each other (``Packed``); both forms count the same phrases. Whole texts are parsed in blocks of
``BLOCK`` letters side by side, one table step per letter for all blocks of a batch, so long texts cost no more per
letter than short ones and memory stays bounded. The tables' size depends on the sample bound alone.

Learning sample (documented bound): per language at most ``SAMPLE_ROWS`` rows, chosen by a hash of the id, of each a
passage of at most ``SAMPLE_CHARS`` letters at a place chosen by the same hash. Letters are lower-cased; a letter that
the language's sample does not hold matches nothing, and everything else counts as space.

A text that is null or has no letter is ``und`` with score 0. Ties go to the first language by name. With no labelled
rows every text is ``und``. Score: the winner's share when each language weighs 2 to the power of minus its phrase bits
(softened), between 0 and 1. Repeated rows and extra columns do not matter.

Rows are told apart as rows: those that share an id, and rows without one, each have a result of their own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keep_rows, prepare, text_batches

UNKNOWN = "und"
SAMPLE_ROWS = 64
SAMPLE_CHARS = 512
#: A language with more letters than this has a packed table instead of a flat one of ``WIDTH`` codes.
ALPHABET = 62
#: Codes: 0 is space (anything but a letter), 1 a letter that no sample holds, then the letters of the samples. In a
#: language's own codes 1 is any letter that its sample does not hold.
SPACE, RARE = 0, 1
WIDTH = 64
BLOCK = 1024
#: Phrase bits are divided by this before languages are weighed against each other for the score.
SOFTEN = 8.0


#: A script belongs to a language if at least this share of its sample's letters is written in it.
SCRIPT_SHARE = 0.01


@dataclass
class Packed:
    """Rows of a sparse table laid over each other: the entry of a state (named by where its row begins) and a code is
    at their sum (modulo the size) if that place is the state's; else a phrase ends and ``root`` leads on."""
    owner: np.ndarray            # place -> the state whose entry it holds
    after: np.ndarray            # place -> next state
    root: np.ndarray             # code -> state after the first letter of a phrase
    first: int                   # the root state


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray            # code point -> code
    own: list[np.ndarray]        # per language: code -> its own code
    #: Per language: state * WIDTH + own code -> next state * WIDTH, plus 1 if a phrase ended; or the same, packed.
    tables: list[np.ndarray | Packed]
    phrase_bits: list[float]     # bits of one phrase: log2 of the sample's length
    script: np.ndarray           # code point -> script, as from ``scripts``
    written: list[np.ndarray]    # per language: script -> whether the language is written in it


def scripts() -> np.ndarray:
    """Code point -> number of its script (the first word of the letter's name); 0 for what is no letter."""
    out, numbers = np.zeros(0x110000, np.uint16), {}
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            script = unicodedata.name(c, "OTHER").split()[0].split("-")[0]
            out[point] = numbers.setdefault(script, len(numbers) + 1)
    return out


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions (letter -> state, per state) of the automaton of all substrings of ``text``."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nexts)
        nexts.append({})
        link.append(-1)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nexts


def parse_table(nexts: list[dict[int, int]]) -> np.ndarray:
    """The flat table of ``Model.tables``: where a match cannot go on, the letter begins the next phrase from the root.
    A letter that the sample never holds ends the phrase it follows and leads back to the root."""
    root = np.zeros(WIDTH, np.int32)
    root[list(nexts[0])] = list(nexts[0].values())
    out = np.tile(root * WIDTH + 1, (len(nexts), 1)).astype(np.int32)
    for state, own in enumerate(nexts):
        out[state, list(own)] = np.array(list(own.values()), np.int32) * WIDTH
    return out.ravel()


def packed_table(nexts: list[dict[int, int]], width: int) -> Packed:
    """The packed form of the same table: rows are laid, longest first, at random places where their entries are free.
    Its size follows the number of transitions, not the number of letters."""
    size = 1 << max(4 * sum(map(len, nexts)), 2 * width).bit_length()
    order = sorted(range(len(nexts)), key=lambda s: -len(nexts[s]))
    rows = [np.array(list(own), np.int64) for own in nexts]
    while True:
        rng = np.random.default_rng(0)
        taken, named = np.zeros(size, bool), np.zeros(size, bool)
        begin = [0] * len(nexts)
        for s in order:
            for _ in range(2000):
                tries = rng.integers(0, size, 16 if len(rows[s]) < 4 else 64)
                free = ~(named[tries] | taken[(tries[:, None] + rows[s]) % size].any(axis=1))
                if free.any():
                    at = int(tries[free.argmax()])
                    break
            else:
                break
            begin[s], named[at] = at, True
            taken[(at + rows[s]) % size] = True
        else:
            break
        size *= 2
    starts = np.array(begin, np.int32)
    owner, after = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    for s, own in enumerate(nexts):
        at = (begin[s] + rows[s]) % size
        owner[at], after[at] = begin[s], starts[list(own.values())]
    root = np.full(width, starts[0], np.int32)
    root[list(nexts[0])] = starts[list(nexts[0].values())]
    return Packed(owner, after, root, int(starts[0]))


def _letter(c: str) -> str:
    """A letter in lower case, as one letter."""
    return c.lower()[0]


def train(samples: dict[str, list[str]]) -> Model:
    """A model from passages per language."""
    letters = sorted({_letter(c) for own in samples.values() for t in own for c in t if c.isalpha()})
    code_of = {c: i + 2 for i, c in enumerate(letters)}
    codes = np.zeros(0x110000, np.uint8 if len(letters) < 254 else np.int32)
    script = scripts()
    for point in np.flatnonzero(script).tolist():
        codes[point] = code_of.get(_letter(chr(point)), RARE)
    model = Model(sorted(samples), codes, [], [], [], script, [])
    for name in model.languages:
        text = np.concatenate([np.zeros(0, codes.dtype), *(
            x for passage in samples[name] for x in (np.zeros(1, codes.dtype), encode(passage, codes)))])
        held = np.unique(text[text > RARE])
        own = np.full(len(letters) + 2, RARE, np.uint8 if len(held) < 254 else np.int32)
        own[SPACE], own[held] = SPACE, np.arange(len(held)) + 2
        nexts = suffix_automaton(own[text].tolist())
        model.own.append(own)
        model.tables.append(parse_table(nexts) if len(held) <= ALPHABET else packed_table(nexts, len(held) + 2))
        model.phrase_bits.append(float(np.log2(max(2, len(text)))))
        used = np.bincount(encode("".join(samples[name]), script), minlength=int(script.max()) + 1)
        used[0] = 0
        model.written.append((used > 0) & (used >= SCRIPT_SHARE * used.sum()))
    return model


def encode(text: str, codes: np.ndarray) -> np.ndarray:
    return codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def phrases(lanes: np.ndarray, used: np.ndarray, table: np.ndarray | Packed) -> np.ndarray:
    """Phrases per lane. ``lanes``: own codes, one row per step; ``used``: lanes that still have a letter, per step (lanes
    are sorted by length, longest first)."""
    n = lanes.shape[1]
    if isinstance(table, Packed):
        return _packed_phrases(lanes, used, table)
    state, count = np.zeros(n, np.int32), np.zeros(n, np.int32)
    at, mark = np.empty(n, np.int32), np.empty(n, np.int32)
    for row, k in zip(lanes, used):
        s, i, m = state[:k], at[:k], mark[:k]
        np.add(s, row[:k], out=i)
        np.take(table, i, out=s, mode="clip")
        np.bitwise_and(s, 1, out=m)
        count[:k] += m
        np.subtract(s, m, out=s)
    return count + (state != 0)


def _packed_phrases(lanes: np.ndarray, used: np.ndarray, table: Packed) -> np.ndarray:
    n, last = lanes.shape[1], len(table.owner) - 1
    state, count = np.full(n, table.first, np.int32), np.zeros(n, np.int32)
    for row, k in zip(lanes, used):
        at = (state[:k] + row[:k]) & last
        on = table.owner[at] == state[:k]
        state[:k] = np.where(on, table.after[at], table.root[row[:k]])
        count[:k] += ~on
    return count + (state != table.first)


def parse(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Phrases of each coded text (none empty) against each language."""
    sizes = np.array([len(t) for t in texts])
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    length = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
    order = np.argsort(-length, kind="stable")
    flat = np.concatenate(texts)
    begin = np.repeat(np.cumsum(sizes) - sizes, blocks)[order] + nth[order] * BLOCK
    length, owner = length[order], owner[order]
    steps = int(length[0])
    lanes = np.zeros((steps, len(order)), flat.dtype)
    for i, (b, n) in enumerate(zip(begin.tolist(), length.tolist())):
        lanes[:n, i] = flat[b:b + n]
    used = len(length) - np.searchsorted(length[::-1], np.arange(steps), side="right")
    out = np.zeros((len(texts), len(model.languages)))
    for j, (own, table) in enumerate(zip(model.own, model.tables)):
        np.add.at(out[:, j], owner, phrases(own[lanes], used, table))
    return out


def judge(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, letters, and mean letters per phrase of the winner, for each text."""
    names, scores, reach = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    coded = [encode(t, model.codes) if t else np.zeros(0, np.uint8) for t in texts]
    letters = np.array([np.count_nonzero(c) for c in coded], np.int64)
    rows = np.flatnonzero(letters).tolist()
    if rows and model.languages:
        found = parse([coded[i] for i in rows], model)
        cost = found * np.array(model.phrase_bits)
        best = cost.argmin(axis=1)
        share = np.exp2(-(cost - cost.min(axis=1, keepdims=True)) / SOFTEN)
        for i, b in zip(rows, best):
            names[i] = model.languages[b]
        scores[rows] = 1 / share.sum(axis=1)
        reach[rows] = letters[rows] / found[np.arange(len(rows)), best]
    return names, scores, letters, reach


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in text_batches(batches, most=2 << 20):
            names, scores, letters, reach = judge(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(letters),
                 pa.array(reach)], ["doc_id", "lang_pred", "score", "letters", "phrase_letters"])
    return run


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Passages per language from ``labelled`` (doc_id, text, lang). Ids are ranked first, so that only the chosen rows'
    texts move: at most ``rows`` passages of ``chars`` letters per language reach the driver."""
    order = F.xxhash64(F.col("doc_id"), F.lit("language sample"))
    usable = labelled.where("lang is not null and text is not null and doc_id is not null")
    ranked = usable.select("doc_id", "lang", order.alias("_o")).withColumn(
        "_n", F.row_number().over(Window.partitionBy("lang").orderBy("_o", "doc_id"))).where(F.col("_n") <= rows)
    chosen = [r["doc_id"] for r in ranked.select("doc_id").collect()]
    start = F.pmod(order, F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    got = usable.where(F.col("doc_id").isin(chosen)).select("lang", "doc_id", F.substring("text", start, chars).alias("t"))
    out: dict[str, list[str]] = {}
    for r in sorted(got.collect(), key=lambda r: (r["lang"], r["doc_id"], r["t"])):
        own = out.setdefault(r["lang"], [])
        if len(own) < rows:
            own.append(r["t"])
    return out


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, letters, phrase_letters) of every row of ``docs``; learns from ``labelled`` (doc_id,
    text, lang)."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(train(sample(labelled)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(_predict(sent),
                    "doc_id bigint, lang_pred string, score double, letters bigint, phrase_letters double")


def accepts(texts: list[str | None], model: Model) -> np.ndarray:
    """Which texts are in a learned language: not those without a letter, nor those of five letters and more of which
    less than a quarter is written in a script of the winner's (however many letters the script has)."""
    names, _, letters, _ = judge(texts, model)
    out = np.array(names) != UNKNOWN
    place = {name: i for i, name in enumerate(model.languages)}
    for i in np.flatnonzero(out & (letters >= 5)).tolist():
        out[i] = 4 * np.count_nonzero(model.written[place[names[i]]][encode(texts[i], model.script)]) >= letters[i]
    return out


def keep_identified(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a learned language, as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(train(sample(labelled)))
    return keep_rows(docs, lambda texts: accepts(texts, sent.value))
