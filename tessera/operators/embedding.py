"""Texts to vectors with an injected embedder: calls in flight inside a task, and passes that commit while they run.

A pass deals its texts into hash slices. Every slice is embedded and written on its own and counts once its marker exists;
a pass that breaks off keeps the slices it has committed, and the next call goes on with the others, replacing whatever a
broken slice has left. Only what no committed slice holds is ever asked of the embedder.
"""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import truncate_text
from tessera.operators.joins import anti_done, first_seen_dedupe
from tessera.operators.layout import spread
from tessera.sources.folders import Folder

# Batch size, calls in flight and back-off of the embedding calls.
EMBED_BATCH = 64
EMBED_WORKERS = 8
RETRY_STEP_S = 5
RETRY_MAX_S = 60
EMBED_ATTEMPTS = 8
# Texts of a slice: what a crash may lose.
SLICE_ROWS = 65_536

Embedder = Callable[[list], np.ndarray]


def hash_embedder(dim: int) -> Embedder:
    """Deterministic test embedder (no network): hashed token counts, L2-normalized."""
    import re
    import xxhash

    def embed(texts):
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for tok in re.findall(r"\w+", (t or "").lower()):
                h = xxhash.xxh64_intdigest(tok)
                out[i, h % dim] += 1.0 if (h >> 63) == 0 else -1.0
            n = np.linalg.norm(out[i])
            if n > 0:
                out[i] /= n
        return out
    return embed


def letter_embedder(letters: str) -> Embedder:
    """How often each of ``letters`` occurs in a text, as it is written: a vector that SQL can compute as well."""
    def embed(texts):
        return np.array([[(t or "").count(c) for c in letters] for t in texts], dtype=np.float32)
    return embed


def embed_batch(embedder: Embedder, texts: list, dim: int, attempts: int = EMBED_ATTEMPTS,
                sleep=time.sleep) -> np.ndarray:
    """One call of the embedder. Transport errors are tried again after growing waits, ``attempts`` calls in all; an
    answer of another shape than (texts, ``dim``) is an error of its own and not asked for again."""
    for wait in [min(RETRY_STEP_S * n, RETRY_MAX_S) for n in range(1, attempts)] + [None]:
        try:
            answer = np.asarray(embedder(texts), dtype=np.float32)
            break
        except OSError:
            if wait is None:
                raise
            sleep(wait)
    if answer.shape != (len(texts), dim):
        raise ValueError(f"embedder answered with shape {answer.shape}, expected {(len(texts), dim)}")
    return answer


def in_order(items: Iterable, call: Callable, window: int) -> Iterator:
    """``call`` on every item, at most ``window`` at a time, results in the items' order. An item is taken only when there
    is room for its call; the first error is raised in its place, and calls not yet begun are dropped."""
    waiting: deque = deque()
    with ThreadPoolExecutor(max_workers=window) as pool:
        try:
            for item in items:
                waiting.append(pool.submit(call, item))
                if len(waiting) == window:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()
        finally:
            for call_ in waiting:
                call_.cancel()


def batch_embed(df: DataFrame, id_col: str, text_col: str, embedder: Embedder, dim: int, batch: int = EMBED_BATCH,
                attempts: int = EMBED_ATTEMPTS, workers: int = EMBED_WORKERS) -> DataFrame:
    """(id, vector): texts go to ``embedder`` ``batch`` at a time, up to ``workers`` calls of a task at once; every answer
    is shape-checked and a failing call is tried again a bounded number of times. Rows keep their order. A task holds
    ``workers`` batches of texts and answers beside its input batch."""
    id_type = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
        for pdf in batches:
            ids, texts = pdf["id"].tolist(), pdf["text"].tolist()
            for s in range(0, len(ids), batch):
                yield ids[s:s + batch], texts[s:s + batch]

    def ask(part: tuple[list, list]) -> pd.DataFrame:
        return pd.DataFrame({"id": part[0], "vector": list(embed_batch(embedder, part[1], dim, attempts))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_order(cut(batches), ask, workers)

    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInPandas(
        run, f"id {id_type}, vector array<float>")


@dataclass(frozen=True)
class EmbeddedTable:
    """Vectors stored pass by pass and slice by slice below ``path``: ``pass=P/slice=S`` holds Parquet files and, once the
    slice is whole, a marker. ``_todo/pass=P`` holds the texts of a pass until it is complete."""

    spark: SparkSession
    path: str

    def folder(self, *parts: str) -> Folder:
        return Folder(self.spark, "/".join([self.path.rstrip("/"), *parts]))

    def passes(self) -> list[str]:
        return sorted(name for name in self.folder().names() if name.startswith("pass="))

    def open_passes(self) -> list[str]:
        return [p for p in self.passes() if not self.folder(p, "_COMPLETE").exists()]

    def committed(self) -> list[str]:
        """Folders to read: a complete pass as one, of an open one the slices that have their marker."""
        out = []
        for p in self.passes():
            if self.folder(p, "_COMPLETE").exists():
                out.append(p)
            else:
                out += [f"{p}/{s}" for s in self.folder(p).names() if s.startswith("slice=")
                        and self.folder(p, s, "_COMMITTED").exists()]
        return out

    def rows(self, schema: str, only: str | None = None) -> DataFrame:
        """(id, vector) of everything committed, or of one pass."""
        paths = [f"{self.path.rstrip('/')}/{p}" for p in self.committed() if only is None or p.split("/")[0] == only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    def begin(self, todo: DataFrame, slice_rows: int) -> str | None:
        """Store the texts of a new pass, dealt into slices of about ``slice_rows`` by a hash of the id; None if there are
        none. The pass exists once its texts are stored whole."""
        name = f"pass={uuid.uuid4().hex}"
        draft = self.folder("_draft", name)
        todo.write.parquet(draft.path)
        texts = self.spark.read.schema(todo.schema).parquet(draft.path)
        n = texts.count()
        if not n:
            return None
        slices = -(-n // slice_rows)
        dealt = texts.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
        dealt.hint("rebalance", F.col("slice")).write.partitionBy("slice").parquet(self.folder("_todo", name).path)
        self.folder(name).make()
        draft.remove()
        return name

    def run(self, name: str, embed: Callable[[DataFrame], DataFrame], schema: str, at_once: int) -> None:
        """Embed and commit the slices of a pass that are not committed yet, ``at_once`` side by side (while one ends its
        last tasks the next is under way). The first error ends the pass; slices committed by then stay."""
        todo = self.folder("_todo", name)

        def one(part: str) -> None:
            texts = self.spark.read.schema(schema).parquet(f"{todo.path}/{part}")
            embed(texts).write.mode("overwrite").parquet(self.folder(name, part).path)
            self.folder(name, part, "_COMMITTED").touch()
        left = [s for s in todo.names() if s.startswith("slice=") and not self.folder(name, s, "_COMMITTED").exists()]
        for _ in in_order(sorted(left, key=lambda s: int(s.split("=")[1])), one, at_once):
            pass
        self.folder(name, "_COMPLETE").touch()
        todo.remove()


def resume_embed(source_df: DataFrame, done_df: DataFrame | None, embedder: Embedder, dim: int, id_col: str = "id",
                 text_col: str = "text", max_chars: int = 800, limit: int = 0, batch: int = EMBED_BATCH,
                 target: str | None = None, order: list[str] | None = None, slice_rows: int = SLICE_ROWS,
                 at_once: int = 2) -> DataFrame:
    """One resumable pass into the embedded table at ``target`` (a scratch table if none is given); returns the (id,
    vector) rows that it committed. A pass that broke off is taken up first: its committed slices stay, the others are
    embedded anew. Then come the ids that neither ``done_df`` nor the table holds, the first occurrence of each (empty id or
    text skipped; first by the columns ``order``, by the text itself if none are given), cut to ``max_chars``. ``limit``
    counts full batches only: the first ceil(limit / batch) · batch texts by id."""
    from tessera.session import scratch_path
    spark, by = source_df.sparkSession, list(order or [text_col])
    table = EmbeddedTable(spark, target or scratch_path(spark, f"embedded-{uuid.uuid4().hex}"))
    id_type = source_df.schema[id_col].dataType.simpleString()
    texts, vectors = f"id {id_type}, text string", f"id {id_type}, vector array<float>"

    def embed(part: DataFrame) -> DataFrame:
        return batch_embed(part, "id", "text", embedder, dim, batch)
    begun = table.open_passes()
    for name in begun:
        table.run(name, embed, texts, at_once)
    own = source_df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                           *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)])
    todo = anti_done(own, table.rows(vectors).select("id"), "id")
    if done_df is not None:
        todo = anti_done(todo, done_df.select(F.col(id_col).alias("id")), "id")
    todo = first_seen_dedupe(todo, ["id"], [f"_by{i}" for i in range(len(by))], nonempty=["text"])
    todo = todo.select("id", truncate_text(F.col("text"), max_chars).alias("text"))
    if limit:
        todo = todo.orderBy("id").limit(-(-limit // batch) * batch)
    fresh = table.begin(todo, slice_rows)
    if fresh:
        table.run(fresh, embed, texts, at_once)
    out = None
    for name in [*begun, *([fresh] if fresh else [])]:
        part = table.rows(vectors, only=name)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], vectors)
