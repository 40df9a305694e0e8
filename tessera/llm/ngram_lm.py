"""N-gram language model in an Elias-Fano trie, trained and queried shard by shard.

The corpus is read once into blocks: a block is a batch of documents as word numbers with the sorted 64-bit keys of its
words. A word's key decides its shard. Blocks send each shard the keys they hold with their training counts; the shard
adds them up over all blocks, numbers its words, and answers every block with counts and numbers, so each block knows
what it asked about and no task or driver ever holds the vocabulary. Pairs of neighbouring words go the same way: the
shard of a context adds up the counts of its successors, writes them into a trie (monotone context ids and pointers,
successor ids relative to their context, one quantised probability each, one quantised back-off weight per context) and
answers the blocks' pairs by successor search within the context's range. What is gathered is proportional to the
distinct words and pairs of the blocks. The words and the trie of every shard stay in the shared folder as the model, one row
per shard, and answer the blocks of other documents in the same way, the trie read in place. Contexts seen in more than one of ``HOT`` tokens are divided into ``PARTS`` by
their successor's key, so that no shard gets a frequent word whole.

Model: base probability of a word (c + 1) / (N + V + 1), with one unknown word. After context h a seen word has
(c(h, w) - D) / (c(h) + B); the rest of the mass, (D * successors of h + B) / (c(h) + B), goes to the other words in
proportion to their base probability (for a part of a hot context: its share of that mass, among its part of the words).
A context that training never saw gives the base probability. Probabilities are quantised to a byte, weights to two, on
a log scale.

Tokens: words are runs of bytes other than space and 0x09-0x0D after lower-casing A-Z, then one end, which is also the
context of the first word. Null and empty texts have the end alone. Repeated rows count as often as they occur; extra
columns are ignored; with no training row every token is unknown, N = V = 0.

Rows are told apart as rows: those that share an id, and rows without one (which count as training rows), each have a score
of their own. Counts are 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import (ASCII_LOWER, ASCII_UPPER, mix64, partitions_for, prepare, scratch, stored, text_batches,
                                word_keys)
from tessera.llm.elias_fano import Trie

DISCOUNT, BACK = 0.75, 1.0
HOT, PARTS = 2048, 16
#: Key of the end token, and the number of an unknown word.
END = np.uint64(0x5DEECE66D)
UNKNOWN = np.uint64(1 << 40)
#: Quantisation on a log10 scale: steps per decade, and for weights the code of 1.
PROB_STEPS, WEIGHT_STEPS, WEIGHT_ONE = 20.0, 2000.0, 32768
_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _squeeze(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, all first bytes first, then all second bytes, and so on."""
    import zstandard
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(
        np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _array(raw: bytes, dtype) -> np.ndarray:
    import zstandard
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(dtype).ravel()


# --- blocks ---------------------------------------------------------------------------------------------------------

BLOCK_SCHEMA = "block bigint, doc_ids binary, held binary, lengths binary, keys binary, tokens binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, serial = TaskContext.get().partitionId(), 0
    for batch in text_batches(batches):
        raw = [(t or "").encode("utf-8").translate(_LOWER) for t in batch.column("text").to_pylist()]
        begin = np.cumsum([0, *[len(r) + 1 for r in raw]])
        starts, keys = word_keys(np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), _IS_WORD)
        words = np.bincount(np.searchsorted(begin, starts, side="right") - 1, minlength=len(raw))
        ends = np.cumsum(words + 1) - 1
        every = np.full(len(keys) + len(raw), END, np.uint64)
        inside = np.ones(len(every), bool)
        inside[ends] = False
        every[inside] = keys
        unique, tokens = np.unique(every, return_inverse=True)
        ids = batch.column("doc_id")
        row = {"block": (part << 24) + serial, "doc_ids": ids.fill_null(0).to_numpy().tobytes(),
               "held": (batch.column("held").to_numpy(zero_copy_only=False).astype(np.uint8)
                        + 2 * ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)).tobytes(),
               "lengths": (words + 1).astype(np.int64).tobytes(), "keys": _squeeze(unique),
               "tokens": _squeeze(tokens.astype(np.uint32))}
        serial += 1
        yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), *[
            (c, pa.binary()) for c in ("doc_ids", "held", "lengths", "keys", "tokens")]]))


class Block:
    """A block's arrays, and what its words' shards answered."""

    def __init__(self, row: dict, answers: list[tuple[int, bytes, bytes]] = (), bases: np.ndarray | None = None):
        self.doc_ids, held = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["held"], np.uint8)
        self.held, self.no_id = held & 1 == 1, held >= 2
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.keys = _array(row["keys"], np.uint64)
        self.tokens = _array(row["tokens"], np.uint32).astype(np.int64)
        self.ends = np.cumsum(self.lengths) - 1
        self.starts = self.ends + 1 - self.lengths
        self.training = np.repeat(~self.held, self.lengths)
        if answers:
            self.count = np.concatenate([_array(c, np.uint64) for _, c, _ in answers]).astype(np.int64)
            self.number = np.concatenate([_array(i, np.uint32).astype(np.uint64) + bases[s] for s, _, i in answers])

    def training_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.training], minlength=len(self.keys))

    def pairs(self, total: int, hot_at: int) -> tuple[np.ndarray, ...]:
        """Distinct (context, word) of the block, by place in ``keys``: contexts, words, training counts, the pair of
        each token, and the trie's context (number and part) and word number."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = np.searchsorted(self.keys, END)
        n = len(self.keys)
        pair, of_token = np.unique(before * n + self.tokens, return_inverse=True)
        context, word = pair // n, pair % n
        seen = np.bincount(of_token[self.training], minlength=len(pair))
        hot = self.count[context] * hot_at > total
        known = self.count[word] > 0
        part = np.where(hot & known, _part(self.keys[word]), 0)
        return (context, word, seen, of_token, self.number[context] * np.uint64(PARTS) + part.astype(np.uint64),
                np.where(known, self.number[word], UNKNOWN))


def _part(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(PARTS - 1)).astype(np.int64)


def _shard_of_key(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ascending with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


# --- words ----------------------------------------------------------------------------------------------------------

def _word_parcels(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                counts = block.training_counts().astype(np.uint32)
                cut = np.searchsorted(_shard_of_key(block.keys, shards), np.arange(shards + 1))
                yield pa.RecordBatch.from_pylist(
                    [{"shard": s, "block": row["block"], "keys": _squeeze(block.keys[a:b]),
                      "counts": _squeeze(counts[a:b])} for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b],
                    pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()),
                               ("counts", pa.binary())]))
    return run


WORD_SCHEMA = ("shard bigint, block bigint, counts binary, numbers binary, n_words bigint, n_tokens bigint, "
               "part_mass array<double>, keys binary")
_WORD_TYPES = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("counts", pa.binary()), ("numbers", pa.binary()),
                         ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("part_mass", pa.list_(pa.float64())),
                         ("keys", pa.binary())])


def _add_words(table: pa.Table) -> pa.Table:
    """Counts and numbers for every block's keys of one shard, and a row (block null) of totals and of the shard's words in
    the order of their numbers."""
    shard = table.column("shard")[0].as_py()
    keys = [_array(k, np.uint64) for k in table.column("keys").to_pylist()]
    counts = [_array(c, np.uint32).astype(np.int64) for c in table.column("counts").to_pylist()]
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(unique)).astype(np.int64)
    known = total > 0
    number = np.cumsum(known) - 1
    number[~known] = 0
    mass = np.bincount(_part(unique[known]), total[known] + 1, PARTS)
    rows = [{"shard": shard, "block": None, "n_words": int(known.sum()), "n_tokens": int(total.sum()),
             "part_mass": mass.tolist(), "keys": _squeeze(unique[known]), "counts": _squeeze(total[known].astype(np.uint64))}]
    begin = 0
    for block, own in zip(table.column("block").to_pylist(), keys):
        mine = at[begin:begin + len(own)]
        begin += len(own)
        rows.append({"shard": shard, "block": block, "counts": _squeeze(total[mine].astype(np.uint64)),
                     "numbers": _squeeze(number[mine].astype(np.uint32))})
    return pa.Table.from_pylist(rows, _WORD_TYPES)


def _ask_words(parcels: pa.Table, words: pa.Table) -> pa.Table:
    """What a stored model's words of one shard say about the blocks' keys: counts (0 if unknown) and numbers."""
    own, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if words.num_rows:
        own = _array(words.column("keys")[0].as_py(), np.uint64)
        counts = _array(words.column("counts")[0].as_py(), np.uint64)
    rows = []
    for shard, block, raw in zip(*(parcels.column(c).to_pylist() for c in ("shard", "block", "keys"))):
        keys = _array(raw, np.uint64)
        at = np.minimum(np.searchsorted(own, keys), max(0, len(own) - 1))
        hit = own[at] == keys if len(own) else np.zeros(len(keys), bool)
        rows.append({"shard": shard, "block": block, "numbers": _squeeze(np.where(hit, at, 0).astype(np.uint32)),
                     "counts": _squeeze(np.where(hit, counts[at] if len(own) else 0, 0).astype(np.uint64))})
    return pa.Table.from_pylist(rows, _WORD_TYPES)


# --- pairs ----------------------------------------------------------------------------------------------------------

PAIR_SCHEMA = "shard bigint, block bigint, contexts binary, context_counts binary, sizes binary, words binary, " \
              "word_counts binary, seen binary"
_PAIR_FIELDS = ("contexts", "context_counts", "sizes", "words", "word_counts", "seen")


def _order(contexts: np.ndarray, words: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a block's pairs by shard, context and word, and the shard of each in that order."""
    shard = (mix64(contexts) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((words, contexts, shard))
    return order, shard[order]


def _runs(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(contexts) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(contexts)))


def _joined(table: pa.Table) -> list[tuple[int, bytes, bytes]]:
    rows = zip(*(table.column(c).to_pylist() for c in ("shard", "counts", "numbers")))
    return sorted(rows, key=lambda r: r[0])


def _pair_parcels(facts, shards: int):
    def run(blocks: pa.Table, words: pa.Table) -> pa.Table:
        total, bases = facts.value["tokens"], facts.value["bases"]
        row = blocks.to_pylist()[0]
        block = Block(row, _joined(words), bases)
        context, word, seen, _, ctx, num = block.pairs(total, facts.value["hot"])
        some = np.flatnonzero(block.count[context] > 0)
        order, shard = _order(ctx[some], num[some], shards)
        some = some[order]
        cut = np.searchsorted(shard, np.arange(shards + 1))
        out = []
        for s in range(shards):
            own = some[cut[s]:cut[s + 1]]
            if len(own):
                first, sizes = _runs(ctx[own])
                parts = (ctx[own][first], block.count[context[own[first]]], sizes.astype(np.uint32), num[own],
                         block.count[word[own]].astype(np.uint64), seen[own].astype(np.uint32))
                out.append({"shard": s, "block": row["block"],
                            **{k: _squeeze(v) for k, v in zip(_PAIR_FIELDS, parts)}})
        return pa.Table.from_pylist(out, pa.schema([("shard", pa.int64()), ("block", pa.int64()),
                                                    *[(c, pa.binary()) for c in _PAIR_FIELDS]]))
    return run


def build_trie(contexts: np.ndarray, context_counts: np.ndarray, sizes: np.ndarray, words: np.ndarray,
               counts: np.ndarray, base: np.ndarray, part_mass: np.ndarray) -> bytes:
    """Layout of the trie of smoothed, quantised values. ``contexts`` (number times PARTS plus part) and ``words`` ascending,
    ``counts`` above zero, ``base``: base probability of each successor, ``part_mass``: that of each context's part."""
    h = np.repeat(context_counts, sizes)
    codes = quantise_probability((counts - DISCOUNT) / (h + BACK))
    first = np.cumsum(sizes) - sizes
    reached = np.add.reduceat(base, first) if len(first) else np.zeros(0)
    return Trie.layout(contexts, sizes, words, codes, quantise_weight(back_off(sizes, context_counts, part_mass, reached)))


def back_off(successors, count, part_mass, reached):
    """Factor of the base probability for words that do not follow: left-over mass by their base mass."""
    return (DISCOUNT * successors + BACK * part_mass) / ((count + BACK) * np.maximum(part_mass - reached, 1e-12))


def quantise_probability(p: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 for log10 p; 0 means not seen."""
    return np.clip(np.rint(-np.log10(p) * PROB_STEPS) + 1, 1, 255).astype(np.uint8)


def quantise_weight(w: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log10(w) * WEIGHT_STEPS) + WEIGHT_ONE, 0, 65535).astype(np.uint16)


REPLY_SCHEMA = "shard bigint, block bigint, codes binary, weights binary, trie binary"
_REPLY_TYPES = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("codes", pa.binary()), ("weights", pa.binary()),
                          ("trie", pa.binary())])


class _Asked:
    """The pairs of all blocks that one shard answers about."""

    def __init__(self, table: pa.Table, facts: dict):
        self.table, self.got = table, [[_array(x, d) for x in table.column(c).to_pylist()] for c, d in zip(
            _PAIR_FIELDS, (np.uint64, np.int64, np.uint32, np.uint64, np.uint64, np.uint32))]
        self.contexts, self.context_counts, sizes, self.words, self.word_counts, self.seen = (
            np.concatenate(x) for x in self.got)
        self.sizes = sizes.astype(np.int64)
        self.every = np.repeat(self.contexts, self.sizes)
        hot = self.context_counts * facts["hot"] > facts["tokens"]
        self.part_mass = facts["part_mass"][np.where(hot, (self.contexts % np.uint64(PARTS)).astype(np.int64), PARTS)]

    def trie(self, z: int) -> bytes:
        """The trie of the training pairs of all blocks added up."""
        every, words = self.every, self.words
        train = np.flatnonzero(self.seen)
        order = train[np.lexsort((words[train], every[train]))]
        c, w = every[order], words[order]
        new = np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])) if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        counts = np.add.reduceat(self.seen[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        base = (self.word_counts[order][first].astype(float) + 1) / z
        run_at, run_size = _runs(c[first])
        unique_c, at = np.unique(self.contexts, return_index=True)
        own = at[np.searchsorted(unique_c, c[first][run_at])]
        return build_trie(c[first][run_at], self.context_counts[own], run_size, w[first], counts, base, self.part_mass[own])

    def answers(self, trie: Trie) -> list[dict]:
        """A row per block: a byte per pair, two per context."""
        of_context, place = trie.lookup(self.every, self.words)
        codes = np.where(place >= 0, trie.codes[np.maximum(place, 0)], 0).astype(np.uint8) if trie.successors.n \
            else np.zeros(len(self.every), np.uint8)
        lead = of_context[np.cumsum(self.sizes) - self.sizes]
        weights = quantise_weight(back_off(0, self.context_counts, self.part_mass, 0.0))
        known = lead >= 0
        weights[known] = trie.weights[lead[known]]
        rows, a, b = [], 0, 0
        for shard, block, n, m in zip(self.table.column("shard").to_pylist(), self.table.column("block").to_pylist(),
                                      map(len, self.got[0]), map(len, self.got[3])):
            rows.append({"shard": shard, "block": block, "codes": _squeeze(codes[b:b + m]),
                         "weights": _squeeze(weights[a:a + n])})
            a, b = a + n, b + m
        return rows


def _answer_pairs(facts):
    """The shard's trie (block null) and its answers to the blocks it was built from."""
    def run(table: pa.Table) -> pa.Table:
        asked = _Asked(table, facts.value)
        layout = asked.trie(facts.value["tokens"] + facts.value["words"] + 1)
        kept = {"shard": table.column("shard")[0].as_py(), "block": None, "trie": layout}
        return pa.Table.from_pylist([kept, *asked.answers(Trie.mapped(layout))], _REPLY_TYPES)
    return run


def _ask_pairs(facts):
    """A stored model's answers to the pairs of other blocks: the shard's trie is read where it lies in its row."""
    def run(pairs: pa.Table, tries: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return pa.Table.from_pylist([], _REPLY_TYPES)
        none = np.zeros(0, np.int64)
        layout = tries.column("trie")[0].as_buffer() if tries.num_rows else build_trie(
            none.astype(np.uint64), none, none, none.astype(np.uint64), none, none.astype(float), none.astype(float))
        return pa.Table.from_pylist(_Asked(pairs, facts.value).answers(Trie(layout)), _REPLY_TYPES)
    return run


# --- scores ---------------------------------------------------------------------------------------------------------

SCORE_SCHEMA = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                "base_score double, score double")


def _scores(facts, shards: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        total, bins, bases = facts.value["tokens"], facts.value["words"], facts.value["bases"]
        of_words = answers.filter(answers.column("kind").to_numpy() == 0)
        of_pairs = answers.filter(answers.column("kind").to_numpy() == 1).sort_by("shard")
        block = Block(blocks.to_pylist()[0], _joined(of_words.rename_columns(["kind", "shard", "block", "counts",
                                                                              "numbers"])), bases)
        base = np.log10((block.count + 1) / (total + bins + 1))
        context, word, _, of_token, ctx, num = block.pairs(total, facts.value["hot"])
        value = base[word]
        some = np.flatnonzero(block.count[context] > 0)
        if len(some):
            order, _ = _order(ctx[some], num[some], shards)
            some = some[order]
            codes = np.concatenate([_array(x, np.uint8) for x in of_pairs.column("a").to_pylist()]).astype(float)
            weights = np.concatenate([_array(x, np.uint16) for x in of_pairs.column("b").to_pylist()]).astype(float)
            first, sizes = _runs(ctx[some])
            rest = np.repeat((weights - WEIGHT_ONE) / WEIGHT_STEPS, sizes) + base[word[some]]
            value[some] = np.where(codes > 0, (1 - codes) / PROB_STEPS, rest)
        known = np.add.reduceat(block.count[block.tokens] > 0, block.starts, dtype=np.int64)
        return pa.table({
            "doc_id": pa.array(block.doc_ids, mask=block.no_id), "held_out": pa.array(block.held),
            "n_tokens": pa.array(block.lengths), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(known), total, np.int64)),
            "base_score": pa.array(np.add.reduceat(base[block.tokens], block.starts)),
            "score": pa.array(np.add.reduceat(value[of_token], block.starts))})
    return run


@dataclass
class NgramModel:
    """A trained model in the shared folder: per shard its words (keys and counts in the order of their numbers) and its
    trie, and the facts that all tasks need (sums, first numbers of the shards, hot rule, masses)."""

    spark: SparkSession
    words_path: str
    replies_path: str
    shards: int
    facts: dict

    def words(self) -> DataFrame:
        return self.spark.read.schema(WORD_SCHEMA).parquet(self.words_path).where("block is null")

    def tries(self) -> DataFrame:
        return self.spark.read.schema(REPLY_SCHEMA).parquet(self.replies_path).where("block is null").select("shard", "trie")


@contextmanager
def _stored_blocks(docs: DataFrame, held_out, partitions: int) -> Iterator[DataFrame]:
    """The blocks, bucketed by block, so that joining answers to them moves the answers only. The table leaves the catalog
    at the end; plans made of it read its files."""
    spark = docs.sparkSession
    name = f"lm_blocks_{scratch(spark, 'x').rsplit('-', 1)[1]}"
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                 F.coalesce(held_out, F.lit(False)).alias("held")).mapInArrow(_blocks, BLOCK_SCHEMA)
     .write.bucketBy(partitions, "block").option("path", scratch(spark, "lm-blocks")).saveAsTable(name))
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")


def _parcels(blocks: DataFrame, shards: int) -> DataFrame:
    return blocks.select("block", "doc_ids", "held", "lengths", "keys", "tokens").mapInArrow(
        _word_parcels(shards), "shard bigint, block bigint, keys binary, counts binary")


def _scored(blocks: DataFrame, answers: DataFrame, replies: DataFrame, facts, shards: int) -> DataFrame:
    both = answers.select(F.lit(0).alias("kind"), "shard", "block", F.col("counts").alias("a"),
                          F.col("numbers").alias("b")).union(
        replies.where("block is not null").select(F.lit(1), "shard", "block", "codes", "weights"))
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_scores(facts, shards), SCORE_SCHEMA)


def train_and_score(docs: DataFrame, held_out, hot: int = HOT) -> tuple[DataFrame, NgramModel]:
    """The scores of every row of ``docs`` (doc_id, text) by a model of the rows where the Column ``held_out`` is false, and
    that model, which can be asked about other documents (``score_by``)."""
    spark = prepare(docs.sparkSession)
    partitions = partitions_for(docs)
    shards = 4 * partitions  # several to a task, so that tasks get about as much each
    with _stored_blocks(docs, held_out, partitions) as blocks:
        words_path, replies_path = scratch(spark, "lm-words"), scratch(spark, "lm-replies")
        _parcels(blocks, shards).groupBy("shard").applyInArrow(_add_words, WORD_SCHEMA).write.option(
            "compression", "zstd").parquet(words_path)
        words = spark.read.schema(WORD_SCHEMA).parquet(words_path)
        # one row per shard
        sums = words.where("block is null").select("shard", "n_words", "n_tokens", "part_mass").orderBy("shard").collect()
        bases = np.zeros(shards, np.uint64)
        for r in sums:
            bases[r["shard"] + 1:] += np.uint64(r["n_words"])
        total, bins = sum(r["n_tokens"] for r in sums), sum(r["n_words"] for r in sums)
        mass = sum((np.array(r["part_mass"]) for r in sums), np.zeros(PARTS)) / (total + bins + 1)
        mass[0] += 1 / (total + bins + 1)  # the unknown word is in part 0
        model = NgramModel(spark, words_path, replies_path, shards, {
            "tokens": total, "words": bins, "bases": bases, "hot": hot, "part_mass": np.append(mass, 1.0)})
        facts = spark.sparkContext.broadcast(model.facts)
        answers = words.where("block is not null").select("shard", "block", "counts", "numbers")
        pairs = (blocks.groupBy("block").cogroup(answers.groupBy("block"))
                 .applyInArrow(_pair_parcels(facts, shards), PAIR_SCHEMA))
        pairs.groupBy("shard").applyInArrow(_answer_pairs(facts), REPLY_SCHEMA).write.option(
            "compression", "zstd").parquet(replies_path)
        replies = spark.read.schema(REPLY_SCHEMA).parquet(replies_path)
        return _scored(blocks, answers, replies, facts, shards), model


def score(docs: DataFrame, held_out, hot: int = HOT) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by a model of the rows where the Column ``held_out`` is false: doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text)."""
    return train_and_score(docs, held_out, hot)[0]


def score_by(model: NgramModel, docs: DataFrame) -> DataFrame:
    """The same columns for documents that the model has not learnt from (all held out): their blocks ask the shards of the
    stored model, which answer from their words and their tries."""
    spark = prepare(docs.sparkSession)
    with _stored_blocks(docs, F.lit(True), partitions_for(docs)) as blocks:
        facts = spark.sparkContext.broadcast(model.facts)
        answers = stored(_parcels(blocks, model.shards).groupBy("shard").cogroup(model.words().groupBy("shard"))
                         .applyInArrow(_ask_words, WORD_SCHEMA).select("shard", "block", "counts", "numbers"), "lm-answers")
        pairs = (blocks.groupBy("block").cogroup(answers.groupBy("block"))
                 .applyInArrow(_pair_parcels(facts, model.shards), PAIR_SCHEMA))
        replies = stored(pairs.groupBy("shard").cogroup(model.tries().groupBy("shard"))
                         .applyInArrow(_ask_pairs(facts), REPLY_SCHEMA), "lm-replies")
        return _scored(blocks, answers, replies, facts, model.shards)
