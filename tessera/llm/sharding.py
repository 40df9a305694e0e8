"""Shards of near-equal bytes for indivisible groups, by Karmarkar-Karp differencing.

Equal texts form a group that stays in one shard. Groups are pre-aggregated, and each block of groups is partitioned
``shards`` ways by differencing: the two partial partitions with the largest spread are combined, one in descending
and the other in ascending order, until one is left. The blocks' results are partial partitions themselves, so the
same rule combines them, ``FAN`` blocks in a task at a time, until one is left; that sees one row of ``shards`` sums per
block of ``BLOCK_GROUPS`` groups, never documents, and nothing passes the driver but the number of blocks. The law is
``bytes``.

A null text counts as empty (size 8, CRC 0). Repeated rows and rows without id are separate rows of their group; groups of
equal size are taken in the order of their digests.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ROW, numbered, stored

#: Groups that one differencing run combines in memory.
BLOCK_GROUPS = 50_000
#: Blocks whose sums a task combines.
FAN = 2000
#: Bytes counted for a row beside its text.
ROW_BYTES = 8


def difference(parts: list[list[int]], k: int) -> list[list[int]]:
    """Combine partial ``k``-way partitions (lists of at most k sums) into one by largest differencing. Returns, for
    each partial partition, the final place of each of its k sums."""
    if not parts:
        return []
    # a node is (sums in descending order, its slots in that order); slots are leaves or pairs of slots
    heap = []
    for i, sums in enumerate(parts):
        padded = [*sums, *[0] * (k - len(sums))]
        order = sorted(range(k), key=lambda s, v=padded: -v[s])
        values = [padded[s] for s in order]
        heap.append((values[-1] - values[0], i, values, [(i, s) if s < len(sums) else None for s in order]))
    heapq.heapify(heap)
    serial = len(parts)
    while len(heap) > 1:
        _, _, high, mine = heapq.heappop(heap)
        _, _, other, theirs = heapq.heappop(heap)
        sums = [a + b for a, b in zip(high, reversed(other))]
        slots = [a if b is None else b if a is None else (-1, (a, b)) for a, b in zip(mine, reversed(theirs))]
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        values = [sums[s] for s in order]
        heapq.heappush(heap, (values[-1] - values[0], serial, values, [slots[s] for s in order]))
        serial += 1
    place = [[0] * max(1, len(p)) for p in parts]
    for shard, slot in enumerate(heap[0][3]):
        todo = [slot]
        while todo:
            at = todo.pop()
            if at is None:
                continue
            if at[0] == -1:
                todo.extend(at[1])
            else:
                place[at[0]][at[1]] = shard
    return place


def _blocks(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, rows, have = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal serial, rows, have
            t = pa.Table.from_batches(rows)
            sizes = t.column("bytes").to_numpy().tolist()
            place = difference([[s] for s in sizes], k)
            block = (part << 24) + serial
            serial, rows, have = serial + 1, [], 0
            out = pa.table({"digest": t.column("digest"), "bytes": t.column("bytes"),
                            "block": pa.array(np.full(t.num_rows, block, np.int64)),
                            "part": pa.array(np.fromiter((p[0] for p in place), np.int32, t.num_rows))})
            return out.to_batches()

        for batch in batches:
            if batch.num_rows:
                rows.append(batch)
                have += batch.num_rows
            if have >= BLOCK_GROUPS:
                yield from flush()
        if have:
            yield from flush()
    return run


def _combine(k: int):
    """The sums of one group of blocks (super, block, part, bytes) -> where each of their parts goes."""
    def run(table: pa.Table) -> pa.Table:
        above, blocks = table.column("super")[0].as_py(), np.unique(table.column("block").to_numpy())
        sums = np.zeros((len(blocks), k), np.int64)
        sums[np.searchsorted(blocks, table.column("block").to_numpy()), table.column("part").to_numpy()] = table.column(
            "bytes").to_numpy()
        place = np.array(difference(sums.tolist(), k), np.int32)
        return pa.table({"block": pa.array(np.repeat(blocks, k)), "part": pa.array(np.tile(np.arange(k, dtype=np.int32),
                                                                                          len(blocks))),
                         "super": pa.array(np.full(len(blocks) * k, above, np.int64)), "at": pa.array(place.ravel()),
                         "bytes": pa.array(sums.ravel())})
    return run


def _shard_of_parts(parts: DataFrame, shards: int) -> DataFrame:
    """(block, part, shard): blocks of blocks are differenced until one is left."""
    sums = stored(parts.groupBy("block", "part").agg(F.sum("bytes").alias("bytes")), "shard-sums")
    levels = []
    while True:
        n = sums.select("block").distinct().count()
        dealt = sums.withColumn("super", F.pmod(F.xxhash64("block"), F.lit(max(1, -(-n // FAN)))))
        levels.append(stored(dealt.groupBy("super").applyInArrow(
            _combine(shards), "block bigint, part int, super bigint, at int, bytes bigint"), "shard-level"))
        if n <= FAN:
            break
        sums = levels[-1].groupBy(F.col("super").alias("block"), F.col("at").alias("part")).agg(F.sum("bytes").alias("bytes"))
        sums = stored(sums, "shard-sums")
    out = levels[-1].select("block", "part", F.col("at").alias("shard"))
    for level in levels[-2::-1]:
        above = out.select(F.col("block").alias("super"), F.col("part").alias("at"), "shard")
        out = level.join(above, ["super", "at"]).select("block", "part", "shard")
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, digest (of its group), shard, slot (0, 1, ... in the shard)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias(ROW),
                              (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
                              F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")),
                  "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes")).sortWithinPartitions("digest")
    parts = stored(groups.mapInArrow(_blocks(shards), "digest binary, bytes bigint, block bigint, part int"),
                   "shard-parts")
    placed = parts.join(_shard_of_parts(parts, shards), ["block", "part"]).select("digest", "shard")
    return numbered(rows.join(placed, "digest"), ["shard"], ROW, "slot").drop(ROW)
