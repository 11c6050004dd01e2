"""Exact de-duplication by Patricia tries whose terminal nodes name the owner of each text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobfacts.llm.common import mapped, small, spread
from jobfacts.llm.patricia import Patricia

TRIE_BYTES = 48 << 20
SEEN = 200_000

RUN = pa.schema([("body", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())])
OWNER = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
MEMBER = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("turn", pa.int64())])


def _better(largest: bool):
    pick = max if largest else min
    return lambda a, b: b if a is None else a if b is None else pick(a, b)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _packed(schema: pa.Schema, rows: Iterator[tuple], weight: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[weight]) + 50
        if total > size:
            yield _rows(schema, held)
            held, total = [], 0
    if held:
        yield _rows(schema, held)


def exact_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are. Every task gathers its texts in a trie, hands over whole subtrees when it
    grows past `TRIE_BYTES`, and so sends each of its texts once. These runs are partitioned by length and content
    hash and arrive in that order; the receiving trie merges full byte strings and lets a subtree go as soon as the
    next length and hash begin, so it never holds more than the texts of one length and one hash.

    The owner is the smallest id (`largest`: the largest). Members meet their owner by digest and by a turn: a task
    numbers its own copies of a text, and an owner is there once for each turn, so a hot text is dealt over many tasks.

    A null text counts as empty. A null id never owns a text that has another id; where all are null, keep_id is null.
    Rows that repeat id and text are counted and all marked kept. Other columns are ignored; no rows give no rows.
    """
    better = _better(largest)
    text = F.coalesce(F.col(text_col), F.lit(""))
    bodies = docs.select(F.col(id_col).cast("long").alias("owner"), text.cast("binary").alias("body"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs():
            trie = Patricia(better)
            for batch in small(batches, "body"):
                for owner, body in zip(batch.column("owner").to_pylist(), batch.column("body").to_pylist()):
                    trie.add(body, owner, 1)
                if len(trie) > TRIE_BYTES:
                    yield from trie.spill(TRIE_BYTES // 2)
            yield from trie.spill()

        return _packed(RUN, runs(), 0)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def owners():
            trie, now = Patricia(better), None
            for batch in small(batches, "body"):
                columns = (batch.column(c).to_pylist() for c in ("n_bytes", "content_hash", "body", "owner", "copies"))
                for n, h, body, owner, copies in zip(*columns):
                    if (n, h) != now:
                        for key, keep, size in trie.spill():
                            yield hashlib.sha256(key).hexdigest(), keep, size
                        now = n, h
                    trie.add(body, owner, copies)
            for key, keep, size in trie.spill():
                yield hashlib.sha256(key).hexdigest(), keep, size

        return _packed(OWNER, owners(), 0)

    def take_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            digests = batch.column("text_sha256").to_pylist()
            turns = []
            if len(seen) > SEEN:
                seen.clear()
            for d in digests:
                turns.append(seen.get(d, 0))
                seen[d] = turns[-1] + 1
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_sha256"), pa.array(turns, pa.int64())], schema=MEMBER)

    runs = mapped(bodies, gather, "body binary, owner long, copies long").withColumns(
        {"n_bytes": F.octet_length("body").cast("long"), "content_hash": F.xxhash64("body")}
    )
    sorted_runs = runs.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    owners = mapped(sorted_runs, merge, "text_sha256 string, keep_id long, group_size long")
    turns = spread(docs)
    digests = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
    members = mapped(digests, take_turns, "doc_id long, text_sha256 string, turn long").withColumn(
        "turn", F.pmod("turn", F.lit(turns))
    )
    dealt = owners.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.least("group_size", F.lit(turns)) - 1)))
    return members.join(dealt, ["text_sha256", "turn"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
