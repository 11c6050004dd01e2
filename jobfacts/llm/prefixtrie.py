"""The trie of all conversations' prefixes, with what sharing them saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobfacts.llm.common import mapped, written
from jobfacts.llm.zfast import Key, Node, ZFast

#: A turn is 16 bytes of digest and 4 of length.
UNIT = 20
#: Conversation ids in one piece of a list of members.
PIECE = 4096
#: Bytes of sequences in one trie.
BATCH = 4 << 20
ROWS = 8192


def sequences(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, units: each conversation's turns in order, 20 bytes a turn; rows without an id belong to none.

    Turns are ordered by number, those without one first, and among equal numbers by digest. The texts stay where they
    are read: a turn goes on as the MD5 of role and text (nulls are empty) and the number of code points of the text.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    unit = F.concat(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.hex(F.char_length(text)), 8, "0"))
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), "turn", unit.alias("unit"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), "unit"))), lambda t: t["unit"])
    return rows.groupBy("conv_id").agg(listed.alias("units"))


def rebuilt(convs: DataFrame, head: Column, base: Column, most: int) -> DataFrame:
    """conv_id, units: the first `head` (at most `most`) units of conversation `base`, then the own ones after the first `head`.

    `head` and `base` are columns over conv_id. Only heads are joined; a base must serve few conversations.
    """
    heads = convs.select(F.col("conv_id").alias("base"), F.slice("units", 1, most).alias("heads"))
    own = convs.withColumns({"to": base, "h": head})
    joined = own.join(heads, own["to"] == heads["base"], "left")
    first = F.coalesce(F.slice("heads", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    rest = F.slice("units", F.col("h") + 1, F.greatest(F.size("units"), F.lit(1)))
    return joined.select("conv_id", F.concat(first, rest).alias("units"))


def _distinct(convs: DataFrame) -> DataFrame:
    """key, n, first, ends: each distinct sequence, its number of conversations, their smallest id and the digest of all.

    Ids are gathered in pieces of bounded width and pieces are digested one after the other.
    """
    key = F.unhex(F.array_join("units", ""))
    block = F.floor(F.col("conv_id") / PIECE).cast("long")
    ids = F.array_sort(F.collect_set("conv_id"))
    pieces = convs.select(key.alias("key"), "conv_id", block.alias("block")).groupBy("key", "block").agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, first, digest = None, 0, 0, None
        out: list[tuple] = []

        def done() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "n", "first", "ends"])

        for batch in batches:
            keys, lists = batch.column("key"), batch.column("ids")
            for i in range(batch.num_rows):
                now, ids = keys[i].as_py(), lists[i].as_py()
                if now != key:
                    if key is not None:
                        out.append((key, n, first, digest.hexdigest()))
                    if len(out) >= ROWS:
                        yield done()
                        out.clear()
                    key, n, first, digest = now, 0, ids[0], hashlib.sha256()
                digest.update((("," if n else "") + ",".join(map(str, ids))).encode())
                n += len(ids)
        if key is not None:
            out.append((key, n, first, digest.hexdigest()))
            yield done()

    dealt = pieces.repartition("key").sortWithinPartitions("key", "block").select("key", "ids")
    return mapped(dealt, run, "key binary, n long, first long, ends string")


_NODE = "name binary, depth int, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, open boolean"
_EMPTY = hashlib.sha256().hexdigest()


def _units(key: bytes) -> list[bytes]:
    return [key[i : i + UNIT] for i in range(0, len(key), UNIT)]


def _length(unit: bytes) -> int:
    return int.from_bytes(unit[16:], "big")


def batch_nodes(before: bytes | None, rows: list[tuple], after: bytes | None) -> Iterator[tuple]:
    """The expanded nodes of a batch of distinct sequences (key, n, first, ends) between two neighbours in sorted order.

    A node that is a prefix of a neighbour is open: it may have members in other batches, and its numbers are this
    batch's share of sums. Shares are exact, since the first batch in order that has a prefix is the one that counts it
    as new, and a sequence is a leaf if none that follows goes on from it.
    """
    trie, foreign = ZFast(), []
    for key in (before, after):
        if key is not None:
            foreign.append(Key(_units(key)))
            trie.insert(foreign[-1], None)
    for key, n, first, ends in rows:
        trie.insert(Key(_units(key)), (n, first, ends))
    old = set(foreign[0].names) if before is not None else set()
    shared = {name for f in foreign for name in f.names} | {b""}

    found: dict[int, tuple] = {}  # of a compacted node: members, smallest, leaves, saved below its end, top's saved, new children
    todo: list[tuple[Node, Node | None]] = [(trie.root, None)]
    above: dict[int, Node] = {}
    while todo:
        node, up = todo.pop()
        if up is not None:
            above[id(node)] = up
        todo.extend((child, node) for child in node.children.values())
    for node in trie.bottom_up():
        n, first, leaves, below, fresh = 0, None, 0, 0, 0
        if node.ends:
            n, first, leaves = node.ends[0], node.ends[1], int(not node.children)
        for child in node.children.values():
            cn, cfirst, cleaves, _, csaved, _ = found[id(child)]
            n, leaves, below = n + cn, leaves + cleaves, below + csaved
            if cn:
                first = cfirst if first is None else min(first, cfirst)
                fresh += child.key.names[child.low + 1] not in old
        saved = below
        for d in range(node.high, node.low, -1):
            saved += (n - (node.key.names[d] not in old)) * _length(node.key.units[d - 1]) if n else 0
        found[id(node)] = n, first, leaves, below, saved, fresh

    for node in reversed(trie.bottom_up()):
        n, first, leaves, below, _, fresh = found[id(node)]
        if not n:
            continue
        names, saved = node.key.names, below
        up = above.get(id(node))
        for d in range(node.high, node.low if node.high else -1, -1):
            if d:
                saved += (n - (names[d] not in old)) * _length(node.key.units[d - 1])
            last = d == node.high
            top = d == node.low + 1
            parent = names[d - 1] if d else None
            children = fresh if last else int(names[d + 1] not in old)
            of = None if parent is None or parent in shared else found[id(up)][1] if top else first
            ends = node.ends[2] if last and node.ends else _EMPTY
            yield names[d], d, parent, first, of, n, children, leaves, saved, ends, names[d] in shared


def _tries(sorted_rows: DataFrame) -> DataFrame:
    """The nodes of all batches; rows come by part and key, with the neighbours of a part as rows without a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("name", pa.binary()), ("depth", pa.int32()), ("parent", pa.binary())]
            + [(c, pa.int64()) for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
            + [("ends", pa.string()), ("open", pa.bool_())]
        )

        def built(before, rows, after) -> Iterator[pa.RecordBatch]:
            out = []
            for node in batch_nodes(before, rows, after):
                out.append(node)
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        part, before, rows, size = None, None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                key = r["key"]
                if part != r["part"]:
                    if rows:
                        yield from built(before, rows, None)
                    part, before, rows, size = r["part"], None, [], 0
                if r["n"] is None and not rows:
                    before = key
                    continue
                if rows and (r["n"] is None or size >= BATCH):
                    yield from built(before, rows, key)
                    before, rows, size = rows[-1][0], [], 0
                if r["n"] is not None:
                    rows.append((key, r["n"], r["first"], r["ends"]))
                    size += len(key) + UNIT
        if rows:
            yield from built(before, rows, None)

    return mapped(sorted_rows, run, _NODE)


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the sequences in `convs` (conv_id, units), the empty one (the root) included.

    conv_id is the smallest of the conversations that start with the prefix, n_convs their number, parent_conv_id the
    parent's conv_id (null for the root), n_children and n_leaves the nodes just below and the childless nodes in the
    subtree, saved_tokens the sum over the subtree of (n_convs - 1) times the length of a node's last turn, ends_sha256 the
    digest of the ids that end there, ascending. name is the prefix's 128-bit name.

    Equal sequences become one row first, whatever their number. Distinct ones are sorted into ranges; each range's task
    puts them in batches into z-fast tries together with the neighbouring sequence on either side, and expands the
    compacted nodes' edges. Most nodes are then complete; only prefixes of neighbours are added up over batches, so
    a first turn that most conversations share is a few rows, one a batch. Memory is bounded by a batch.

    Null ids are not conversations; a conversation without turns ends at the root; no conversations give no rows.
    A conversation is one row of 20 bytes a turn, so it may have some 50 million turns.
    """
    keys = written(
        _distinct(convs).repartitionByRange("key").withColumn("part", F.spark_partition_id()), "sequences"
    )
    ends = keys.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = Window.orderBy("part")  # a row a range
    near = ends.select("part", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("first", "long"), ("ends", "string"))]
    around = near.select(F.explode(F.array("before", "after")).alias("key"), *none, "part").filter("key IS NOT NULL")
    dealt = keys.unionByName(around).repartitionById(max(1, ends.count()), "part").sortWithinPartitions("part", "key")
    nodes = written(_tries(dealt), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    met = nodes.filter("open").groupBy("name").agg(
        F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *sums,
        F.max(F.when(F.col("ends") != _EMPTY, F.col("ends"))).alias("ends"),
    )
    met = written(met, "open-nodes")
    parents = met.select(F.col("name").alias("of"), F.col("conv_id").alias("of_conv"))
    shown = ["name", "depth", "parent", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    every = nodes.filter("NOT open").select(shown).unionByName(
        met.withColumns({"parent_conv_id": F.lit(None).cast("long"), "ends": F.coalesce("ends", F.lit(_EMPTY))}).select(shown)
    )
    looked = every.join(parents, (F.col("parent") == F.col("of")) & F.col("parent_conv_id").isNull(), "left")
    return looked.select(
        "name",
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.coalesce("parent_conv_id", "of_conv").alias("parent_conv_id"),
        *["n_convs", "n_children", "n_leaves", "saved_tokens"],
        F.col("ends").alias("ends_sha256"),
    )
