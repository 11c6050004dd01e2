"""WARC archives of pages, and a globally ordered capture index merged from the sorted run of each archive."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobfacts.llm.common import apart, mapped, small, written
from jobfacts.session import shared_folder

#: Records and packed bytes in one archive (a larger record has one of its own), index entries in one task of the merge.
ARCHIVE_RECORDS, ARCHIVE_BYTES, MERGE_ENTRIES = 20_000, 16 << 20, 100_000
#: Unpacked bytes of a gzip member: below 16 MiB the last byte of the size that closes a member is zero.
MEMBER_BYTES = (1 << 24) - 1
END_OF_RECORD = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ID = re.compile(r"<urn:x-page:(-?\d*)>")
ENTRY = "urlkey string, timestamp string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, archive string, offset long, length long"
_KINDS = {"string": pa.string(), "long": pa.int64()}
_ENTRY = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in ENTRY.split(", ")])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """The host from its last part to its first, then the path: captures of one site stand together."""
    if not url:
        return "-"
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip(), flags=re.I)
    host, slash, path = rest.partition("/")
    host = re.sub(r":(80|443)$", "", host.rpartition("@")[2].lower())
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")/" + path


def record(page_id: int | None, url: str | None, date: str, html: str, digest: str, refers_to: int | None, revisit: bool) -> str:
    """One record without the two line ends that close it."""
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    payload = html.encode()
    block = HTTP if revisit else HTTP + html
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT}", f"X-Payload-Length: {len(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(head) + "\r\n\r\n" + block


def packed(record: bytes, most: int = MEMBER_BYTES) -> bytes:
    """A record as a gzip member of its own; one of over `most` bytes as several."""
    return b"".join(gzip.compress(record[at : at + most], 6, mtime=0) for at in range(0, len(record), most))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: Column | None = None) -> None:
    """Write archives of bounded size for each task's share of `pages` (page_id, url, html).

    Of records with equal payloads of at least `least_bytes` bytes, that of the largest page_id is a response and the
    others revisit it. Owners of payloads are found by digest before any payload moves; the payloads then meet their
    owner in a join on the digest, which adaptive execution splits where one payload is very frequent.

    Each record is a gzip member, so its place in the file is all it takes to read it. An archive is a row that Spark's
    text writer puts in a file of its own, whole or not at all: the line's end is the zero byte that closes the last member.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        html.alias("html"),
        F.sha2(html, 256).alias("same"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200)) if date is None else date, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    )
    owners = rows.groupBy("same").agg(F.max("page_id").alias("owner"))
    revisit = ~F.col("page_id").eqNullSafe(F.col("owner")) & (F.octet_length("html") >= least_bytes)
    known = rows.join(apart(owners, "same"), "same").withColumn("revisit", revisit).drop("same")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            return pa.record_batch([pa.array([b"".join(members)[:-1]], pa.binary())], names=["value"])

        for batch in small(batches, "html"):
            for r in batch.to_pylist():
                digest = payload_digest(r["html"].encode())
                text = record(r["page_id"], r["url"], r["date"], r["html"], digest, r["owner"] if r["revisit"] else None, r["revisit"])
                member = packed((text + END_OF_RECORD).encode(), MEMBER_BYTES)
                if members and (size + len(member) > ARCHIVE_BYTES or len(members) == ARCHIVE_RECORDS):
                    yield archive()
                    members, size = [], 0
                members.append(member)
                size += len(member)
        if members:
            yield archive()

    archives = mapped(known, run, "value binary").select(F.col("value").cast("string"))
    archives.write.options(lineSep="\0", maxRecordsPerFile=1).text(folder)


class Members:
    """The bytes of a file's gzip members one after the other; one member at a time is unpacked."""

    def __init__(self, body) -> None:
        self.body, self.at = memoryview(body), 0
        self.open, self.read_to = b"", 0

    def _next(self) -> bool:
        if self.at >= len(self.body):
            return False
        unpack, out, at = zlib.decompressobj(31), [], self.at
        while not unpack.eof:
            if at >= len(self.body):
                raise ValueError(f"the member at {self.at} is cut short")
            out.append(unpack.decompress(self.body[at : at + 8192]))
            at += 8192
        self.open = b"".join([self.open[self.read_to :], *out])
        self.read_to, self.at = 0, min(at, len(self.body)) - len(unpack.unused_data)
        return True

    def read(self, size: int) -> bytes:
        while len(self.open) - self.read_to < size and self._next():
            pass
        part = self.open[self.read_to : self.read_to + size]
        self.read_to += len(part)
        return part

    def readline(self) -> bytes:
        while (end := self.open.find(b"\n", self.read_to)) < 0 and self._next():
            pass
        return self.read((len(self.open) if end < 0 else end + 1) - self.read_to)

    def tell(self) -> int:
        """Where the next member begins, which must be where the next record does."""
        if self.read_to < len(self.open):
            raise ValueError(f"a record ends inside the member before {self.at}")
        return self.at


def read_records(stream, archive: str) -> Iterator[tuple]:
    """The entries (`ENTRY`) of an archive's records; lengths rule, so payloads may contain anything.

    Places and lengths are those of `stream.tell()`: of `Members`, bytes of the packed file.
    """
    at = stream.tell()
    while first := stream.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"{archive}: no record at {at}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[key] = value
        block = stream.read(int(head["Content-Length"]))
        close = stream.read(4)
        if len(block) != int(head["Content-Length"]) or close != END_OF_RECORD.encode():
            raise ValueError(f"{archive}: the record at {at} is cut short")
        payload = block.partition(b"\r\n\r\n")[2]
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and payload_digest(payload) != digest:
            raise ValueError(f"{archive}: the payload of the record at {at} is damaged")
        number = lambda name: int(x) if name in head and (x := _ID.match(head[name])[1]) else None
        url = head.get("WARC-Target-URI")
        length = int(head["X-Payload-Length"]) if revisit else len(payload)
        yield (
            url_key(url), re.sub(r"\D", "", head["WARC-Date"]), number("WARC-Record-ID"), head["WARC-Type"],
            number("WARC-Refers-To"), length, digest, url, archive, at, stream.tell() - at,
        )
        at = stream.tell()


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[8], entry[9]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """`ENTRY` and run: the entries of every archive in `folder`, each archive a run in order."""
    files = _archives(spark, folder)
    schema = _ENTRY.append(pa.field("run", pa.string())).append(pa.field("place", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("path")[i].as_py().rpartition("/")[2]
                entries = sorted(read_records(Members(batch.column("content")[i].as_buffer()), name), key=_order)
                yield _table([(*e, name, k) for k, e in enumerate(entries)], schema)

    return mapped(files, run, f"{ENTRY}, run string, place long")


def payloads(spark: SparkSession, folder: str, entries: DataFrame) -> DataFrame:
    """`entries` (columns of `ENTRY`) and payload: the bytes of each capture, cut out of its archive by place and length.

    A revisit has no bytes of its own: its payload is null, and `refers_to` names the page to ask for. An entry whose
    archive is not in `folder` is left out. Only the cut records leave the tasks that read the archives.
    """
    files = _archives(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    cut = F.substring("content", F.col("offset").cast("int") + 1, F.col("length").cast("int"))
    rows = entries.select(*_ENTRY.names).join(files, "archive").select(*_ENTRY.names, cut.alias("member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "member"):
            kinds = batch.column("record_type").to_pylist()
            found = []
            for kind, member in zip(kinds, batch.column("member")):
                block = gzip.decompress(member.as_buffer())
                body = block.split(b"\r\n\r\n", 2)[2][: -len(END_OF_RECORD)]
                found.append(body if kind == "response" else None)
            columns = [batch.column(name) for name in _ENTRY.names] + [pa.array(found, pa.binary())]
            yield pa.record_batch(columns, names=[*_ENTRY.names, "payload"])

    return mapped(rows, run, f"{ENTRY}, payload binary")


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of each match, so a new head replays one path only."""

    def __init__(self, sources: list[Iterator], key) -> None:
        self.sources, self.key = sources, key
        self.heads = [next(s, None) for s in sources]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * len(sources)
        self.winner = -1
        for i in range(len(sources)):
            self._climb(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _climb(self, i: int) -> None:
        node = (i + len(self.sources)) // 2
        while node > 0:
            rival = self.losers[node]
            if rival == -1:  # the other side of this match is still to come
                self.losers[node] = i
                return
            if self._beats(rival, i):
                self.losers[node], i = i, rival
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        while self.sources and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self.heads[i] = next(self.sources[i], None)
            self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])
            self._climb(i)


def merged(entries: DataFrame) -> DataFrame:
    """`ENTRY` in global order of URL key, timestamp and page, from sorted runs.

    The range of keys is split evenly over tasks (by key, time and page together, so captures of one URL may go to
    several), each of which merges its piece of every run through a loser tree. Tasks are as many as keep each at
    about `MERGE_ENTRIES` entries; partitions are in order and so is each of them inside.
    """
    tasks = entries.count() // MERGE_ENTRIES + 1
    dealt = entries.repartitionByRange(tasks, "urlkey", "timestamp", "page_id").sortWithinPartitions("run", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[tuple]] = {}
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in (*_ENTRY.names, "run")))
            for *entry, name in rows:
                pieces.setdefault(name, []).append(tuple(entry))
        out = []
        for entry in LoserTree([iter(p) for p in pieces.values()], _order):
            out.append(entry)
            if len(out) == 10_000:
                yield _table(out, _ENTRY)
                out = []
        yield _table(out, _ENTRY)

    return mapped(dealt, run, ENTRY)


def capture_index(pages: DataFrame, least_bytes: int = 0, date: Column | None = None) -> DataFrame:
    """Archives of `pages` (page_id, url, html) in the shared folder, read back as one ordered index (`ENTRY`).

    One entry per row. A null html is an empty payload; a null url has the key "-"; a null page_id revisits an equal
    payload that has an id and is a response where none has, as are all rows that repeat the id of the response.
    Digests of responses are recomputed from what the archive holds. Other columns are ignored, no rows give none.
    """
    folder = shared_folder(pages.sparkSession, "archives")
    write_archives(pages, folder, least_bytes, date)
    return merged(written(runs(pages.sparkSession, folder), "runs"))
