"""Shards of near-equal bytes for indivisible groups, by Karmarkar-Karp differencing in levels."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobfacts.llm.common import mapped, spread, written

#: Groups that one differencing takes at once, and partial partitions that are combined at once.
GROUPS, FAN_IN = 20_000, 64


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (one row of bin sums each) into one.

    Returns for each row where each of its bins ends up, and the combined sums. The two rows of largest spread are
    taken again and again and joined in opposite orders, the fullest bin of one with the emptiest of the other.
    """
    n, bins = sums.shape
    order = np.argsort(sums, 1, kind="stable")
    heap = []
    state: dict[int, np.ndarray] = {}
    for i in range(n):
        state[i] = np.take_along_axis(sums[i], order[i], 0)
        heap.append((-int(state[i][-1] - state[i][0]), i))
    heapq.heapify(heap)
    # The slots of a node are its bins in rising order. A node of a row names the row's bins; a later one says which
    # slot each slot of its two parts became.
    into: dict[int, tuple[int, int, np.ndarray, np.ndarray]] = {}
    following = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = state.pop(a) + state.pop(b)[::-1]
        rising = np.argsort(joined, kind="stable")
        slot = np.empty(bins, np.int64)
        slot[rising] = np.arange(bins)
        into[following] = a, b, slot, slot[::-1]
        state[following] = joined[rising]
        heapq.heappush(heap, (-int(joined.max() - joined.min()), following))
        following += 1
    top = heap[0][1]
    where: dict[int, np.ndarray] = {top: np.arange(bins)}
    for node in range(following - 1, n - 1, -1):
        a, b, slot_a, slot_b = into.pop(node)
        final = where.pop(node)
        where[a], where[b] = final[slot_a], final[slot_b]
    places = np.empty((n, bins), np.int64)
    for i in range(n):
        places[i][order[i]] = where[i]
    return places, state[top]


def _partials(groups: DataFrame, bins: int) -> DataFrame:
    """part, key, bin, and on the first row of each part its bin sums: groups spread over bins, some thousand at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32

        def done(keys: list[pa.Array], sizes: list[np.ndarray]) -> pa.RecordBatch:
            size = np.concatenate(sizes)
            sums = np.zeros((len(size), bins), np.int64)
            sums[:, 0] = size
            places, total = difference(sums)
            rows = len(size)
            return pa.record_batch(
                [
                    pa.array(np.full(rows, part)),
                    pa.concat_arrays(keys),
                    pa.array(places[:, 0].astype(np.int32)),
                    pa.array([total.tolist()] + [None] * (rows - 1), pa.list_(pa.int64())),
                ],
                names=["part", "key", "bin", "sums"],
            )

        keys, sizes, held = [], [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, GROUPS):
                piece = batch.slice(begin, GROUPS)
                if held and held + piece.num_rows > GROUPS:
                    yield done(keys, sizes)
                    part, keys, sizes, held = part + 1, [], [], 0
                keys.append(piece.column("key"))
                sizes.append(np.array(piece.column("size")))
                held += piece.num_rows
        if held:
            yield done(keys, sizes)

    return mapped(groups.select("key", "size"), run, "part long, key string, bin int, sums array<long>")


def _combined(partials: DataFrame, parents: int) -> DataFrame:
    """part, places, parent, sums: where each part's bins go in its parent; `sums` of the parent on one of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[dict]) -> pa.RecordBatch:
            places, total = difference(np.array([r["sums"] for r in rows], np.int64))
            return pa.record_batch(
                [
                    pa.array([r["part"] for r in rows], pa.int64()),
                    pa.array(places.tolist(), pa.list_(pa.int64())),
                    pa.array([r["parent"] for r in rows], pa.int64()),
                    pa.array([total.tolist()] + [None] * (len(rows) - 1), pa.list_(pa.int64())),
                ],
                names=["part", "places", "parent", "sums"],
            )

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["parent"] != row["parent"]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    given = partials.withColumn("parent", F.pmod(F.xxhash64("part"), F.lit(parents)))
    dealt = given.repartition("parent").sortWithinPartitions("parent", "part")
    return mapped(dealt, run, "part long, places array<long>, parent long, sums array<long>")


def balance(groups: DataFrame, bins: int) -> DataFrame:
    """key, shard for each row of `groups` (key string, size long): shards of near-equal total size.

    Some thousand groups at a time are spread over all bins by differencing, within each task. What comes out are
    partial partitions, of which only the bin sums go on: up to `FAN_IN` of them are differenced again, level by level,
    until one is left; then each group's bin is followed up. Only the number of parts is known to the driver.
    """
    assigned = written(_partials(groups, bins), "partial-bins")
    level = assigned.filter("sums IS NOT NULL").select("part", "sums")
    n = level.count()
    placed = assigned.select("key", F.col("part").alias("at"), F.col("bin").cast("long").alias("shard"))
    while n > 1:
        parents = 1 if n <= FAN_IN else -(-n // (FAN_IN // 2))
        joined = written(_combined(level, parents), "combined-bins")
        step = joined.select(F.col("part").alias("at"), "places", "parent")
        placed = placed.join(step, "at").select("key", F.col("parent").alias("at"), F.col("places")[F.col("shard").cast("int")].alias("shard"))
        level = joined.filter("sums IS NOT NULL").select(F.col("parent").alias("part"), "sums")
        n = level.count()
    return placed.select("key", F.col("shard").cast("int").alias("shard"))


def _numbered(rows: DataFrame, shards: int) -> DataFrame:
    """`rows` with slot: from 0 without gaps in each shard, counted in many parts of a shard at once."""
    parts = max(1, spread(rows))
    counted = written(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(parts)).cast("int")), "sharded")
    sizes = counted.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_sha256")
    return (
        counted.withColumn("k", F.row_number().over(inside))
        .join(offsets, ["shard", "part"])
        .withColumn("slot", F.col("first") + F.col("k") - 1)
        .drop("part", "k", "first")
    )


def shard_by_bytes(docs: DataFrame, shards: int, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, text_sha256, shard (0 to shards - 1), slot.

    size is the UTF-8 bytes of the text plus `overhead`. Documents of equal text form a group that no shard boundary
    cuts; shards are as near to equal in bytes as differencing makes them, which a group larger than a shard's share
    limits. Groups are summed before they are shuffled; a text that a third of the rows share is one group of one
    number, and meets its rows again in a join that adaptive execution may split. slot numbers each shard's rows from
    0 without gaps.

    A null text has no bytes and is equal to the empty one. Null ids are rows like any other; rows that repeat id and
    text take slots of their own. Other columns are ignored, no rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("text_sha256"),
        ),
        "sizes",
    )
    groups = rows.groupBy(F.col("text_sha256").alias("key")).agg(F.sum("size").alias("size"))
    placed = balance(groups, shards)
    return _numbered(rows.join(placed, rows["text_sha256"] == placed["key"]).drop("key"), shards)
