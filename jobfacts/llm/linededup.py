"""Line de-duplication by pairwise alignment: shared rare lines find the pairs, patience diff aligns them."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfacts.llm.common import apart, mapped, written


def lines_of(text) -> object:
    """The lines of a text column, each without blanks at its ends."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))


def by_turn(earlier: list[int], a: int, b: int, later: list[int], c: int, d: int) -> list[tuple[int, int]]:
    """Pairs of the k-th occurrences of equal lines in earlier[a:b] and later[c:d], in the order of the later."""
    places = defaultdict(deque)
    for i in range(a, b):
        places[earlier[i]].append(i)
    return [(places[later[j]].popleft(), j) for j in range(c, d) if places.get(later[j])]


def patience(earlier: list[int], later: list[int]) -> list[tuple[int, int]]:
    """Aligned equal lines (place in the earlier, place in the later), both rising, by patience diff.

    Between two places, lines that occur once on each side are matched and the longest rising chain of them is kept;
    the stretches between go through the same again, and runs of equal lines at both ends of a stretch are aligned
    first. In a stretch without such lines the first occurrences of a line on both sides are matched, then the second
    ones, and so on, so no stretch that is left has a line in common.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(earlier), 0, len(later))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and earlier[a] == later[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and earlier[b - 1] == later[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(earlier[a:b]), Counter(later[c:d])
        place = {x: i for i, x in enumerate(earlier[a:b], a) if left[x] == 1 and right[x] == 1}
        pairs = [(place[x], j) for j, x in enumerate(later[c:d], c) if x in place]
        if not pairs:
            pairs = by_turn(earlier, a, b, later, c, d)
        if not pairs:
            continue
        tops: list[int] = []
        chain: list[int] = []
        back = [-1] * len(pairs)
        for k, (i, _) in enumerate(pairs):
            at = bisect_left(tops, i)
            if at:
                back[k] = chain[at - 1]
            tops[at : at + 1], chain[at : at + 1] = [i], [k]
        k, anchors = chain[-1], []
        while k >= 0:
            anchors.append(pairs[k])
            k = back[k]
        bounds = [(a - 1, c - 1), *anchors[::-1], (b, d)]
        out += anchors
        todo += [(i + 1, m, j + 1, n) for (i, j), (m, n) in zip(bounds, bounds[1:]) if i + 1 < m and j + 1 < n]
    return sorted(out)


#: Stands for a line that no other document has.
ALONE = 0


def place_keys(lines: list[int], rare: set[int]) -> list[set[int]]:
    """For each place what names it in its surroundings: a rare line itself, any other the lines from the next rare one on either side to it.

    No key reaches over a line that is `ALONE`: no other document could have it.
    """
    out: list[set[int]] = [set() for _ in lines]
    for side, order in enumerate((range(len(lines)), range(len(lines) - 1, -1, -1))):
        held = None
        for j in order:
            if lines[j] == ALONE:
                held = None
            elif lines[j] in rare:
                held = lines[j]
            elif held is not None:
                held = hash((side, held, lines[j]))
            if held is not None:
                out[j].add(held)
    return out


def common_blocks(earlier: list[int], later: list[int], rare: set[int]) -> list[int]:
    """Places in `later` of aligned lines that stand in an unbroken block with a rare line in it, and of further copies.

    A further copy is a rare line of such a block that stands in `later` once more, with as much of the block as stands
    around it there.
    """
    gone: list[int] = []
    owned: set[int] = set()
    block: list[tuple[int, int]] = []
    for pair in [*patience(earlier, later), (-9, -9)]:
        if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
            if any(later[j] in rare for _, j in block):
                gone += [j for _, j in block]
                owned.update(*place_keys([later[j] for _, j in block], rare))
            block = []
        block.append(pair)
    if len(gone) in (0, len(later)):
        return gone
    return sorted({*gone, *(j for j, keys in enumerate(place_keys(later, rare)) if keys & owned)})


#: How many times as many earlier sharers of a line the next turn tries as the turn before.
MORE = 16


def _doc(id_col: str, text_col: str) -> Column:
    """Names a document by id and text, null without an id; names sort as ids do."""
    digits = F.lpad((F.col(id_col).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(digits, F.substring(F.md5(F.coalesce(F.col(text_col), F.lit(""))), 1, 16))


def _id(doc: Column) -> Column:
    return (F.substring(doc, 1, 20).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def _hashed(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc, hashes of all lines (`ALONE` for those that one document has), long (the different other ones of min_words words).

    Only documents that share a long line are left, and what a document has alone weighs next to nothing in a shuffle.
    """
    narrow = docs.select(_doc(id_col, text_col).alias("doc"), lines_of(F.col(text_col)).alias("lines")).filter("doc IS NOT NULL")
    every = written(
        narrow.select(
            "doc",
            F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
            F.array_distinct(F.transform(F.filter("lines", lambda x: F.size(F.split(x, r"\s+")) >= min_words), lambda x: F.xxhash64(x))).alias("long"),
        ).dropDuplicates(["doc"]),
        "line-hashes",
    )
    each = every.filter(F.size("long") > 0).select("doc", F.explode(F.array_distinct("hashes")).alias("line"))
    common = each.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1").select("line")
    shared = each.join(apart(common, "line"), "line").groupBy("doc").agg(F.collect_set("line").alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, hashes, long, lines in zip(*(batch.column(c).to_pylist() for c in ("doc", "hashes", "long", "shared"))):
                lines = set(lines)
                if held := [x for x in long if x in lines]:
                    out.append((doc, [x if x in lines else ALONE for x in hashes], held))
            columns = list(zip(*out)) or [[], [], []]
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc", "hashes", "long"])

    return written(mapped(every.join(shared, "doc"), run, "doc string, hashes array<long>, long array<long>"), "shared-lines")


def _aligned(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """doc, owner, places that go from each of `pairs` (doc, owner, rare)."""
    later = pairs.join(hashed.select("doc", F.col("hashes").alias("later")), "doc")
    both = later.join(hashed.select(F.col("doc").alias("owner"), F.col("hashes").alias("earlier")), "owner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("doc", "owner", "earlier", "later", "rare"))
            for doc, owner, earlier, after, rare in zip(*columns):
                own = [(k,) if x == ALONE else x for k, x in enumerate(earlier)]  # equal to nothing else
                if gone := common_blocks(own, after, set(rare)):
                    out.append((doc, owner, gone))
            yield pa.record_batch(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.list_(pa.int32()))],
                names=["doc", "owner", "places"],
            )

    return mapped(both.select("doc", "owner", "earlier", "later", "rare"), run, "doc string, owner string, places array<int>")


def repeated_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, owner, places: lines (from 0) of a document that stand aligned in the earlier document `owner` (see `_doc`).

    A line of at least `min_words` words that occurs in more than one document belongs to the one of smallest id, its
    owner; documents overlap where one has a line of the other's. So a line that n documents share makes n - 1 pairs,
    however common it is, and each pair is aligned by patience diff on hashes of all lines; blocks of aligned lines with
    such a line in them are reported for the later document. What only another earlier document aligns is left; see
    `lines_repeated_anywhere`.
    """
    hashed = _hashed(docs, min_words, id_col, text_col)
    each = hashed.select("doc", F.explode("long").alias("line"))
    owners = each.groupBy("line").agg(F.min("doc").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    pairs = each.join(apart(owners, "line"), "line").filter("doc > owner").groupBy("doc", "owner").agg(F.collect_set("line").alias("rare"))
    return _aligned(pairs, hashed)


def _keys(hashed: DataFrame) -> DataFrame:
    """doc, key: the different `place_keys` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc, lines, long = (batch.column(c)[row].as_py() for c in ("doc", "hashes", "long"))
                keys = list(set().union(*place_keys(lines, set(long))))
                yield pa.record_batch([pa.array([doc] * len(keys), pa.string()), pa.array(keys, pa.int64())], names=["doc", "key"])

    return mapped(hashed, run, "doc string, key long")


def _left(wanted: DataFrame, found: DataFrame, hashed: DataFrame) -> DataFrame:
    """doc, key: those of `wanted` (doc, keys) that name a place which is not among the found ones."""
    gone = found.groupBy("doc").agg(F.flatten(F.collect_list("places")).alias("gone"))
    rows = wanted.join(gone, "doc", "left").join(hashed, "doc").select("doc", "keys", "gone", "hashes", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc, keys, gone, lines, long = (batch.column(c)[row].as_py() for c in ("doc", "keys", "gone", "hashes", "long"))
                out = set(gone or ())
                at = set().union(*(k for j, k in enumerate(place_keys(lines, set(long))) if j not in out))
                keys = list(at.intersection(keys))
                yield pa.record_batch([pa.array([doc] * len(keys), pa.string()), pa.array(keys, pa.int64())], names=["doc", "key"])

    return mapped(rows, run, "doc string, key long")


def lines_repeated_anywhere(docs: DataFrame, min_words: int = 5, id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """doc, owner, places like `repeated_lines`, with all lines that alignment with any earlier document finds.

    The places over all owners are those of aligning every pair of documents that share a line of `min_words` words.
    A pair can only add a place if both documents have its key (`place_keys`). So each document is aligned with the
    first owners of its keys; for the places that stay, with other earlier sharers of their keys, about `MORE` of them,
    then `MORE` times as many each turn, until no place or no sharer is left. Which partners come in which turn is
    decided by hashes of their ids; a document whose lines were all found before is not tried and not an owner.
    """
    hashed = _hashed(docs, min_words, id_col, text_col)
    keys = _keys(hashed)
    owners = keys.groupBy("key").agg(F.min("doc").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    share = F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) / float(1 << 30) * F.col("n")
    turn = F.when(F.col("doc") == F.col("owner"), 0).otherwise(F.ceil(F.log(float(MORE), F.greatest(share, F.lit(1.5)))).cast("int"))
    shared = written(keys.join(apart(owners, "key"), "key").select("doc", "key", "owner", turn.alias("turn")), "shared-keys")
    later = shared.filter("doc > owner")
    long = hashed.select("doc", F.col("long").alias("rare"))

    def aligned(pairs: DataFrame) -> DataFrame:
        return written(_aligned(pairs.join(long, "doc"), hashed), "aligned")

    found = aligned(later.select("doc", "owner").distinct())
    last = shared.agg(F.max("turn")).first()[0] or 0
    todo = later
    for t in range(1, last + 1):
        todo = written(_left(todo.groupBy("doc").agg(F.collect_set("key").alias("keys")), found, hashed), "left-keys")
        if todo.isEmpty():
            break
        sharers = shared.filter(F.col("turn") == t).select("key", F.col("doc").alias("owner"))
        pairs = todo.join(sharers, "key").filter("owner < doc").select("doc", "owner").distinct()
        found = found.unionByName(aligned(pairs))
    return found


def without_repeated_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text", find=repeated_lines) -> DataFrame:
    """One row per row of `docs`: doc_id, text (what is left), n_lines, n_removed, removed (places), owners.

    Blocks that `find` (`repeated_lines` or `lines_repeated_anywhere`) finds are deleted from the later document; the first document with a line always
    keeps it. All alignments use the texts as they came, so the order of pairs doesn't matter. A null text stays null
    and has no lines, an empty one has one empty line; a document with a null id neither owns nor loses lines. Of different texts
    with one id the one of the smaller MD5 is the earlier; equal rows are one document. Other columns are ignored.
    """
    found = find(docs, min_words, id_col, text_col)
    gone = found.groupBy("doc").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("removed"), F.array_sort(F.collect_set(_id(F.col("owner")))).alias("owners")
    )
    text = F.col("text")
    lines = F.split(text, "\n")
    nothing = F.array().cast("array<int>")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.coalesce("removed", nothing), i)), "\n")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _doc(id_col, text_col).alias("doc"))
    return rows.join(gone, "doc", "left").select(
        "doc_id",
        F.when(F.col("removed").isNull(), text).otherwise(kept).alias("text"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", nothing).alias("removed"),
        F.coalesce("owners", F.array().cast("array<bigint>")).alias("owners"),
    )
