"""Toxicity by logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Features of a text: its words, pairs of neighbouring words and pairs of words with one between, each hashed to one of
``SIZE`` places; a feature counts once per text. FTRL keeps two sums per place: every coordinate has its own learning
rate, and places whose evidence stays under the L1 strength have weight exactly 0, so the model is a short list of
places and weights, small enough to send to every task whatever the corpus size. Scoring hashes whole batches of text at
once in numpy, looks the places up and sums the distinct ones per text.

Learning sample (documented bound): at most ``SAMPLE_TOXIC`` rows marked 1 and ``SAMPLE_OTHER`` rows marked 0, chosen by
a hash of the id (by chance a few fewer); their features reach the driver as arrays of places, of each text at most
``SAMPLE_PLACES`` of those (the smallest hashes). A document with several labels counts as toxic if any says so.

Words are runs of letters, digits and non-ASCII bytes after lower-casing. A null or empty text has no features and gets
the bias alone. With no labelled row the score is 0. Repeated rows and extra columns do not matter.

Rows are told apart as rows: those that share an id, and rows without one, each have a score of their own. In learning, of
rows that share an id one is used, and rows without id or label are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep_rows, mix64, prepare, stored, text_batches, word_keys

BITS = 22
SIZE = 1 << BITS
SAMPLE_TOXIC, SAMPLE_OTHER = 2000, 4000
#: Bytes of the sample's features; beyond it fewer rows are taken, each whole.
SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.7
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 strength, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 10.0, 1.0, 10

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_NEXT, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass
class Model:
    places: np.ndarray   # with a weight other than 0, ascending
    weights: np.ndarray
    bias: float


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every word, pair and skip pair of the texts, repeats included."""
    raw = [(t or "").lower().encode("utf-8") for t in texts]
    starts_at = np.cumsum([0, *[len(r) + 1 for r in raw]])
    starts, keys = word_keys(np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), _IS_WORD)
    row = np.searchsorted(starts_at, starts, side="right") - 1
    out_row, out = [row], [keys]
    for gap, salt in ((1, _NEXT), (2, _SKIP)):
        if len(keys) > gap:
            same = row[gap:] == row[:-gap]
            out_row.append(row[:-gap][same])
            out.append(mix64(keys[:-gap][same] * salt + keys[gap:][same]))
    return np.concatenate(out_row), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """FTRL-proximal over rows of distinct places; the bias stands after the last of them, and L1 leaves it alone. The
    state covers the places that the rows hold, not all ``SIZE``; the rows stay as they are, numbered when they are used."""
    if not len(rows):
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    held = np.zeros(SIZE, bool)
    for row in rows:
        held[row] = True
    names = np.flatnonzero(held).astype(np.int32)
    number = np.cumsum(held, dtype=np.int32)
    number -= 1
    bias = len(names)
    del held
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        over = np.abs(z[at]) - np.where(at == bias, 0.0, L1)
        return np.where(over > 0, -np.sign(z[at]) * over / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    order = np.random.default_rng(7).permutation(len(rows))
    for _ in range(PASSES):
        for i in order:
            at = np.append(number[rows[i]], bias)
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            step = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - step * w
            n[at] += gradient * gradient
    kept = np.flatnonzero(np.abs(z[:bias]) > L1)
    return Model(names[kept].astype(np.int64), weights(kept), float(weights(np.array([bias]))[0]))


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    total = np.full(len(texts), model.bias)
    if len(model.places):
        row, place = features(texts)
        at = np.minimum(np.searchsorted(model.places, place), len(model.places) - 1)
        hit = model.places[at] == place
        pair = np.unique(row[hit] * len(model.places) + at[hit])
        total += np.bincount(pair // len(model.places), model.weights[pair % len(model.places)], len(texts))
    return np.where(np.isneginf(total), 0.0, 1 / (1 + np.exp(-np.clip(total, -700, 700))))


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in text_batches(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores(batch.column("text").to_pylist(), model))],
                ["doc_id", "score"])
    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, most=1 << 20):
        row, place = features(batch.column("text").to_pylist())
        own = [np.unique(place[row == i]).astype("<i4").tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("turn"),
                                          pa.array(own, pa.binary())], ["doc_id", "label", "turn", "places"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the rows of ``labels`` (doc_id, toxic) whose texts ``docs`` holds."""
    marked = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
              .agg((F.max("toxic") > 0).cast("int").alias("label")))
    # about as many as asked for: the rows whose hash lies in the share of its range that the class size allows; the few
    # above the bound are left out on the driver
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {1: SAMPLE_TOXIC, 0: SAMPLE_OTHER}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity sample")), F.lit(1 << 52)) / float(1 << 52)
    share = F.when(F.col("label") == 1, most[1] / max(1, sizes.get(1, 0))).otherwise(most[0] / max(1, sizes.get(0, 0)))
    chosen = marked.withColumn("turn", place / share).where("turn < 1")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "label", "turn")), "doc_id")
    held = stored(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "turn", "text")
                  .mapInArrow(_sampled, "doc_id bigint, label int, turn double, places binary"), "toxicity-sample")
    # rows in the order of their turn, both classes alike, while their features fit; of rows that share an id the largest
    listed = held.groupBy("doc_id", "label", "turn").agg(F.max(F.length("places")).alias("bytes")).collect()
    listed.sort(key=lambda r: (r["turn"], r["doc_id"]))
    within = [r for r, upto in zip(listed, np.cumsum([r["bytes"] for r in listed])) if upto <= SAMPLE_BYTES]
    if not within:
        return fit([], np.zeros(0))
    # of the rows that share an id one is asked for; they come one part of the table at a time, into one array
    most_bytes = {r["doc_id"]: r["bytes"] for r in within}
    begin = dict(zip(most_bytes, np.cumsum([0, *most_bytes.values()]).tolist()))
    flat = np.zeros(sum(most_bytes.values()), np.uint8)
    marks: dict[int, int] = {}
    for r in held.where(F.col("turn") <= within[-1]["turn"]).select("doc_id", "label", "places").toLocalIterator():
        d, places = r["doc_id"], r["places"]
        if len(places) == most_bytes.get(d):
            own = flat[begin[d]:begin[d] + len(places)]
            if d not in marks or bytes(places) > own.tobytes():
                own[:] = np.frombuffer(places, np.uint8)
            marks[d] = r["label"]
    use = [d for c in (0, 1) for d in [x for x in sorted(marks) if marks[x] == c][:most[c]]]
    rows = [flat[begin[d]:begin[d] + most_bytes[d]].view("<i4") for d in use]
    return fit(rows, np.array([marks[d] for d in use]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(_score(sent), "doc_id bigint, score double") \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return keep_rows(docs, lambda texts: scores(texts, sent.value) < THRESHOLD)
