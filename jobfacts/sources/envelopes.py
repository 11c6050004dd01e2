"""Answers ``{"jobs": [...]}`` of any size, read by many tasks at once.

A file is read in pieces that end with a closing brace, so Spark can cut it anywhere. What a brace means depends on
whether it stands in a string and how deep, which only the text before can tell. So each block is first summed up for
both cases (the number of quotes, and how much deeper the block ends if it begins outside or inside a string); sums
over the blocks before tell every block how it begins. Then blocks give their records, and the parts of a record that
a border cuts are put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobfacts.session import shipped

_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|[{}\[\]]', re.S)
_ESCAPED = re.compile(r"\\.", re.S)
_ESCAPED_BYTE = re.compile(rb"\\.", re.S)
#: An answer's records are objects in a list of the outermost object.
_RECORD = 3
#: How much deeper each byte is, outside strings.
_DEEPER = np.zeros(256, np.int8)
_DEEPER[list(b"{[")], _DEEPER[list(b"]}")] = 1, -1


def measure(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a string is open after the piece, and how much deeper it is then; `inside`: one was open before."""
    if "\\" in piece:
        piece = _ESCAPED.sub("", piece)
    parts = piece.split('"')
    plain = "".join(parts[1::2] if inside else parts[0::2]) if len(parts) > 1 else ("" if inside else piece)
    deeper = plain.count("{") + plain.count("[") - plain.count("]") - plain.count("}")
    return inside ^ (len(parts) % 2 == 0), deeper


class Splitter:
    """Cuts the pieces of a block into records; a piece stands for its text and the closing brace after it."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth = inside, depth
        self.key: str | None = None  # of the list that is open
        self.seen = False  # whether it was opened in this block
        #: What is open at a record's depth: a record, what an earlier block began, a list in the list, or nothing.
        self.held = "cut" if depth >= _RECORD else None
        self.text: list[str] = []

    def feed_all(self, pieces: list[str]) -> Iterator[tuple[str, bool, str | None, bool]]:
        """What `feed` gives for these pieces in turn, each with key and seen; records of one list are cut out at once."""
        found = self._cut("}".join(pieces) + "}") if self.depth >= _RECORD - 1 else None
        for done in map(self.feed, pieces) if found is None else found:
            if done is not None:
                yield *done, self.key, self.seen

    def _cut(self, text: str) -> list[tuple[str, bool]] | None:
        """The records that end in `text`, of which nothing was changed yet if there is more in it than records."""
        if self.held == "list" or (self.depth < _RECORD and self.inside):
            return None
        data = text.encode()
        marks = np.frombuffer(data, np.uint8)
        quotes = marks == ord('"')
        if b"\\" in data:
            quotes[[m.end() - 1 for m in _ESCAPED_BYTE.finditer(data)]] = False
        outside = (np.cumsum(quotes, dtype=np.uint8) & 1) == int(self.inside)
        steps = _DEEPER[marks] * outside
        depth = np.cumsum(steps, dtype=np.int64) + self.depth
        if depth.min() < _RECORD - 1 or (quotes & (depth < _RECORD)).any():
            return None
        begins = np.flatnonzero((steps == 1) & (depth == _RECORD))
        ends = np.flatnonzero((steps == -1) & (depth == _RECORD - 1))
        if (marks[begins] != ord("{")).any() or (marks[ends] != ord("}")).any():
            return None
        found, rest = [], 0
        begins, ends = begins.tolist(), (ends + 1).tolist()
        if self.depth >= _RECORD:
            if not ends:
                self.text.append(text)
                rest = None
            else:
                found.append(("".join(self.text) + data[: ends[0]].decode(), self.held == "record"))
                ends = ends[1:]
        if rest is not None:
            found += [(data[b:e].decode(), True) for b, e in zip(begins, ends, strict=False)]
            open_ = len(begins) > len(ends)
            self.held, self.text = ("record", [data[begins[-1] :].decode()]) if open_ else (None, [])
        self.inside, self.depth = not outside[-1].item(), int(depth[-1])
        return found

    def feed(self, piece: str) -> tuple[str, bool] | None:
        """A record that ends with the piece, and whether it began in this block."""
        if self.depth < _RECORD:
            self._outside(piece)
        else:
            inside, deeper = measure(piece, self.inside)
            left = None if self.held == "record" or "]" not in piece else self._left(piece)
            if left is None:
                self.inside, self.depth = inside, self.depth + deeper
                self.text.append(piece + "}")
            else:  # it was a list
                self.inside, self.depth, self.held, self.text = False, _RECORD - 1, None, []
                self._outside(piece[left:])
        if self.inside:
            return None
        self.depth -= 1
        if self.depth != _RECORD - 1 or self.held is None:
            return None
        record, began = "".join(self.text), self.held == "record"
        self.text, self.held = [], None
        return record, began

    def _closed(self, piece: str) -> int | None:
        """Where the string ends that the piece begins in."""
        found = re.match(r'((?:[^"\\]|\\.)*)"', piece, re.S)
        return found and found.end()

    def _left(self, piece: str) -> int | None:
        """Where a bracket closes what is open at a record's depth."""
        at, depth = self._closed(piece) if self.inside else 0, self.depth
        if at is None:
            return None
        for token in _TOKEN.finditer(piece, at):
            depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(token[0], 0)
            if depth < _RECORD:
                return token.end()
        return None

    def _outside(self, piece: str) -> None:
        """Between records: names of lists, and where the next record begins."""
        at, name = 0, None
        if self.inside:  # a name or text that was cut by a brace in it
            at = self._closed(piece)
            if at is None:
                return
            self.inside = False
        for token in _TOKEN.finditer(piece, at):
            mark = token[0]
            if mark[0] == '"':
                name = token[1]
            elif mark in "{[":
                self.depth += 1
                if self.depth == _RECORD - 1:  # only a list has records
                    self.key, self.seen = name if mark == "[" else None, True
                if self.depth == _RECORD:
                    self.held = "record" if mark == "{" else "list"
                    self.depth -= 1
                    rest = piece[token.start() :]
                    left = None
                    if mark == "[":
                        self.depth += 1
                        left = self._left(rest[1:])
                        self.depth -= 1
                    if left is None:
                        self.inside, deeper = measure(rest, False)
                        self.depth += deeper
                        self.text.append(rest + "}")
                        return
                    self.held = None
                    return self._outside(rest[1 + left :])
            else:
                self.depth -= 1
        self.inside = _ESCAPED.sub("", piece[at:]).count('"') % 2 == 1


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("piece"),
    )


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """The pieces of each block of a batch, whose rows are in order."""
    files, blocks, pieces = (batch.column(c) for c in ("file", "block", "piece"))
    at = 0
    while at < batch.num_rows:
        key, end = (files[at].as_py(), blocks[at].as_py()), batch.num_rows
        if (files[end - 1].as_py(), blocks[end - 1].as_py()) != key:
            end = next(k for k in range(at + 1, end) if (files[k].as_py(), blocks[k].as_py()) != key)
        yield key, pieces[at:end].to_pylist()
        at = end


def _summed(pieces: DataFrame) -> DataFrame:
    """file, block, odd (quotes), outside, inside: of the pieces of a task, which are in the order of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ends = None, [(False, 0), (True, 0)]

        def done() -> pa.RecordBatch:
            rows = [{"file": last[0], "block": last[1], "odd": int(ends[0][0]), "outside": ends[0][1], "inside": ends[1][1]}]
            kinds = [("file", pa.string()), ("block", pa.int64()), ("odd", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64())]
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

        for batch in batches:
            for at, pieces in _stretches(batch):
                if at != last:
                    if last is not None:
                        yield done()
                    last, ends = at, [(False, 0), (True, 0)]
                text = "}".join(pieces) + "}"
                for k in (0, 1):
                    opened, deeper = measure(text, ends[k][0])
                    ends[k] = opened, ends[k][1] + deeper
        if last is not None:
            yield done()

    return pieces.select("file", "block", "piece").mapInArrow(run, "file string, block long, odd long, outside long, inside long")


def _records(pieces: DataFrame, whole: bool) -> DataFrame:
    """file, block, kind (whole, head, middle, tail), key, last_key, text of pieces in order, with how their block begins.

    Either `whole` records, or all else, a few rows a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, splitter, out, size, headed = None, None, [], 0, False
        kinds = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.string()), ("key", pa.string()), ("known", pa.bool_()), ("text", pa.string())])

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

        def finished() -> None:
            if whole:
                return
            if splitter.held == "cut":
                out.append((*last, "middle", splitter.key, splitter.seen, "".join(splitter.text)))
            elif splitter.held is not None:  # of a list in the list: it has no key, and what follows belongs to it
                listed = splitter.held == "list"
                out.append((*last, "tail", None if listed else splitter.key, listed or splitter.seen, "".join(splitter.text)))
            out.append((*last, "key", splitter.key, splitter.seen, None))

        for batch in batches:
            first = 0
            for at, pieces in _stretches(batch):
                if at != last:
                    if last is not None:
                        finished()
                    last, splitter = at, Splitter(batch.column("open")[first].as_py(), batch.column("depth")[first].as_py())
                first += len(pieces)
                for text, began, key, seen in splitter.feed_all(pieces):
                    if began == whole:
                        out.append((*at, "whole" if began else "head", key, seen, text))
                        size += len(text)
                if size > 4 << 20:
                    yield table()
                    out, size = [], 0
        if last is not None:
            finished()
        if out:
            yield table()

    return pieces.select("file", "block", "piece", "open", "depth").mapInArrow(
        run, "file string, block long, kind string, key string, known boolean, text string"
    )


def read_records(spark: SparkSession, path: str, key: str) -> DataFrame:
    """text: the JSON of every object in the list `key` of the answers in `path`, whatever else they hold.

    Answers must be valid JSON. A file is read by as many tasks as it has blocks; a task holds a record at a time and
    blocks in order. Lists of other names are skipped. No files, or no records, give no rows.
    """
    shipped(spark)
    pieces = _pieces(spark, path)
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = _summed(pieces).withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    step = F.when(F.col("open"), F.col("inside")).otherwise(F.col("outside"))
    begins = sums.withColumn("step", step).select("file", "block", "open", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth"))
    # a task read a block's pieces one after the other, so in the order of rows they stand together, and numbers sort fast
    known = pieces.join(begins, ["file", "block"]).repartition("file", "block").sortWithinPartitions("row")
    found = _records(known, whole=False)
    upto = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    keys = found.filter("kind = 'key'").withColumn(
        "held", F.last(F.when(F.col("known"), F.struct("key")), ignorenulls=True).over(upto)["key"]
    ).select("file", "block", "held")
    # heads come before tails in a block
    parts = found.filter("kind IN ('head', 'middle', 'tail')").withColumn("place", F.when(F.col("kind") == "tail", F.lit(1)).otherwise(F.lit(0)))
    running = W.partitionBy("file").orderBy("block", "place").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = parts.withColumn("nth", F.sum("place").over(running))
    joined = parts.groupBy("file", "nth").agg(
        F.array_sort(F.collect_list(F.struct("block", "place", "text"))).alias("texts"),
        F.max(F.when(F.col("kind") == "tail", F.col("block"))).alias("block"),
        F.max(F.when(F.col("kind") == "tail", F.col("key"))).alias("key"),
        F.bool_or((F.col("kind") == "tail") & F.col("known")).alias("known"),
    )
    cut = joined.select("file", "block", "key", "known", F.array_join(F.transform("texts", lambda t: t["text"]), "").alias("text"))
    every = _records(known, whole=True).select("file", "block", "key", "known", "text").unionByName(cut)
    named = every.join(keys, ["file", "block"], "left").withColumn("of", F.when(F.col("known"), F.col("key")).otherwise(F.col("held")))
    return named.filter(F.col("of") == key).select("text")
