"""Near-duplicate documents: SetSketch registers, bands, a joint estimate, and exact confirmation on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobfacts.llm import setsketch
from jobfacts.llm.common import apart, mapped, raw, small, written
from jobfacts.llm.decontam import fixed_filter, passes
from jobfacts.llm.graph import components
from jobfacts.llm.words import mix, shingles, word_hashes

#: Rows of a bucket, and shingles of a family, that one comparison block takes.
BUCKET_BLOCK, FAMILY_BLOCK = 2048, 600_000
#: Standard deviations below the wanted similarity at which an estimate still counts as possible.
DOUBT = 5.0

SKETCHES = "doc_id long, mark binary, n_shingles long, set_a long, set_b long, registers binary"
_SKETCHES = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.binary()), *[(c, pa.int64()) for c in ("n_shingles", "set_a", "set_b")], ("registers", pa.binary())]
)
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    mark = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), mark.alias("mark"), F.col(text_col).alias("text"))


def sketches(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`SKETCHES` for every row: a digest of its text, registers of the set of its shingles, and a 128-bit name of that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text"):
            sets, at = shingles(*word_hashes(batch.column("text")), size)
            with np.errstate(over="ignore"):
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(c)), dtype=np.uint64)]) for c in (1, 2)]
                names = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
            registers = setsketch.sketch(sets, at)
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(np.diff(at)), *map(pa.array, names), pa.array([r.tobytes() for r in registers], pa.binary())]
            yield pa.record_batch(columns, schema=_SKETCHES)

    return mapped(_texts(docs, id_col, text_col), run, SKETCHES)


def _matrix(column: pa.Array) -> np.ndarray:
    return raw(column)[0].reshape(len(column), setsketch.M)


def _bands(sets: DataFrame) -> DataFrame:
    """key, node: a row for each band of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = setsketch.band_keys(_matrix(batch.column("registers")))
                ids = np.repeat(np.array(batch.column("node")), setsketch.BANDS)
                yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "node"])

    return mapped(sets.select("node", "registers"), run, "key long, node long")


def _blocked(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """Rows of a group of several blocks once for each pair of blocks that theirs is in (i <= j, `side` is their own)."""
    own = F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    each = rows.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    each = each.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", blocks)
    return each.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in `names`, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.array(batch.column(n)) for n in names], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            key = tuple(keys[begin].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Forest:
    """Which rows of a block are joined already."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> list[int]:
        """Those of `others` that were not yet joined with i; they are now."""
        new = []
        for k in others.tolist():
            a, b = self.root[i], self.root[k]
            if a != b:
                self.root[self.root == b] = a
                new.append(k)
        return new


def _joined(ids: np.ndarray, forest: _Forest, rows: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    for i, others in rows:
        for k in forest.join(i, others):
            yield int(ids[i]), int(ids[k])


def _near(i: int, regs: np.ndarray, n: np.ndarray, side: np.ndarray, forest: _Forest, share: float) -> np.ndarray:
    """Rows after i that may be so similar to it: another tree of the forest, sizes and equal registers allow it."""
    rest = np.arange(i + 1, len(n))
    rest = rest[forest.root[rest] != forest.root[i]]
    if side[0] != side[-1] or (side != side[0]).any():
        rest = rest[side[rest] != side[i]]
    rest = rest[np.minimum(n[rest], n[i]) >= share * np.maximum(n[rest], n[i])]
    least = setsketch.M * share - DOUBT * np.sqrt(setsketch.M * share * (1 - share)) - 1
    return rest[(regs[rest] == regs[i]).sum(1) >= least] if len(rest) else rest


def _families(sets: DataFrame, share: float) -> DataFrame:
    """a, b: in each bucket, pairs whose estimate allows `share`, as many as join what they join."""
    bands = _bands(sets)
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = bands.join(apart(sizes, "key"), "key").withColumn("blocks", F.ceil(F.col("size") / BUCKET_BLOCK)).drop("size")
    rows = shared.join(sets.select("node", "n_shingles", "registers"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
            regs = _matrix(table.column("registers").chunk(0))
            n, side = (np.array(table.column(c)) for c in ("n_shingles", "side"))
            for i in range(len(n)):
                near = _near(i, regs, n, side, forest, share)
                if len(near):
                    above, below = (regs[i] > regs[near]).sum(1), (regs[i] < regs[near]).sum(1)
                    sizes = np.full(len(near), float(n[i])), n[near].astype(float)
                    doubt = DOUBT * np.sqrt(share * (1 - share) / setsketch.M)
                    yield i, near[setsketch.at_least(above, below, *sizes, share - doubt)]

        out: list[tuple[int, int]] = []
        for table in _groups(batches, ["key", "i", "j"]):
            forest = _Forest(table.num_rows)
            out += _joined(np.array(table.column("node")), forest, pairs(table))
            if len(out) > 100_000:
                yield _links(out)
                out = []
        yield _links(out)

    return mapped(_blocked(rows, "key", "blocks"), run, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=_PAIR)


def _shared_bits(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of bits for each set, over the elements that two of the sets or more have."""
    values, code, times = np.unique(sets, return_inverse=True, return_counts=True)
    common = np.cumsum(times > 1) - 1
    use = times[code] > 1
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[use]
    column = common[code[use]]
    width = (int((times > 1).sum()) + 63) // 64
    bits = np.zeros((len(at) - 1, max(1, width)), np.uint64)
    np.bitwise_or.at(bits, (doc, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    return bits


def _confirmed(docs: DataFrame, sets: DataFrame, share: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """a, b: pairs with 100 * intersection >= share * union, as many as join what they join."""
    families = written(components(written(_families(sets, share / 100), "family-links")), "families")
    members = families.union(families.select(F.col("root").alias("node"), "root").distinct())
    known = written(members.join(sets, "node").select("node", "root", "n_shingles", "registers", "one"), "family-members")
    totals = known.groupBy("root").agg(F.ceil(F.sum("n_shingles") / FAMILY_BLOCK).alias("blocks"))
    known = known.join(totals, "root")
    texts = _texts(docs, id_col, text_col)
    texts = texts.filter(passes(fixed_filter(known.select(F.xxhash64("one").alias("h")), "h"), F.xxhash64(F.struct("doc_id", "mark"))))
    texts = texts.dropDuplicates(["doc_id", "mark"])
    same = known["one"]["doc_id"].eqNullSafe(texts["doc_id"]) & (known["one"]["mark"] == texts["mark"])
    rows = known.join(texts, same).select("node", "root", "n_shingles", "registers", "blocks", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for table in _groups(small(batches, "text"), ["root", "i", "j"]):
            regs = _matrix(table.column("registers").chunk(0))
            n, side, ids = (np.array(table.column(c)) for c in ("n_shingles", "side", "node"))
            bits = _shared_bits(*shingles(*word_hashes(table.column("text").chunk(0)), size))
            forest = _Forest(len(n))

            def pairs() -> Iterator[tuple[int, np.ndarray]]:
                for i in range(len(n)):
                    near = _near(i, regs, n, side, forest, share / 100)
                    if len(near):
                        both = np.bitwise_count(bits[near] & bits[i]).sum(1, dtype=np.int64)
                        yield i, near[100 * both >= share * (n[near] + n[i] - both)]

            out += _joined(ids, forest, pairs())
        yield _links(out)

    return mapped(_blocked(rows, "root", "blocks"), run, "a long, b long")


def near_duplicates(
    docs: DataFrame, share: int = 85, size: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept, component, mark.

    Two documents are linked when their sets of `size`-word shingles meet 100 * intersection >= `share` * union; a
    component is what links reach, named by its smallest doc_id, and kept marks that one. component numbers the
    components (null without shingles) and mark is the MD5 of the text, for callers whose ids repeat.

    Equal sets go on as one. Sets of whole texts become SetSketch registers; the bands of registers make buckets. In a
    bucket, the joint estimate (likelihood of registers above, below and equal, given both sizes) says which sets may
    be linked; such sets form families, and in a family the full sets are compared exactly. Buckets and families are
    taken in blocks of bounded size, every pair of blocks in a task of its own, and a block hands on only as many
    pairs as join its members. A pair at the wanted similarity shares no band in under 1 of 10^8 cases.

    With fewer words than `size` the whole sequence is the one shingle; null, empty and wordless texts have n_shingles
    0 and are linked with nothing. Texts are what is linked, not ids: rows that share an id, or have none, are members
    like any other, and a component without any id has the name null. Of a component every row with its smallest id
    is kept. Other columns are ignored.
    """
    every = written(sketches(docs, size, id_col, text_col), "sketches")
    full = every.filter("n_shingles > 0")
    groups = full.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("doc_id"),
        F.first(F.struct("doc_id", "mark")).alias("one"),  # a row to take the text from
        F.first("n_shingles").alias("n_shingles"),
        F.first("registers").alias("registers"),
    )
    sets = written(groups.withColumn("node", F.monotonically_increasing_id()), "sets")
    links = written(_confirmed(docs, sets, share, size, id_col, text_col), "confirmed")
    roots = components(links)
    linked = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = written(linked.join(sets.select("node", "doc_id"), "node"), "linked")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("least"))
    linked = linked.join(apart(least, "root"), "root").select(F.col("node").alias("at"), "root", "least")
    alone = F.col("root").isNull()
    named = sets.join(linked, sets["node"] == linked["at"], "left").select(
        "set_a", "set_b", F.coalesce("root", "node").alias("component"), F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("name")
    )
    own = every.join(named, (every["set_a"] == named["set_a"]) & (every["set_b"] == named["set_b"]) & (every["n_shingles"] > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("name")).otherwise(F.col("doc_id"))
    return own.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "component", "mark"
    )
