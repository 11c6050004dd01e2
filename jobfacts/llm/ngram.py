"""Language-model scores of whole documents from a sharded n-gram trie learnt from the training documents."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfacts.llm.common import mapped, small, written
from jobfacts.llm.eliasfano import Trie
from jobfacts.llm.words import mix, word_hashes
from jobfacts.session import shared_folder

#: Bytes of text in a chunk; entries of a unigram shard; tokens of the corpus for each bigram shard.
CHUNK_BYTES, WORD_SHARD, PAIR_SHARD = 4 << 20, 1_000_000, 1_000_000
#: A context with more occurrences than this is split over several shards by its successors.
SPLIT = 400_000
#: The largest weight of what a context says; steps of a code for one unit of log10; the code for "not seen".
WEIGHT, STEPS, ABSENT = 0.7, 4096, 65535
#: The end token, a number no word's hash is meant to have.
END = mix(np.array([0xE0D], np.uint64))

CHUNK = "chunk long, doc_id array<long>, held array<boolean>, n_tokens binary, words binary, seen binary, tokens binary"
_CHUNK = pa.schema(
    [("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.binary()), ("words", pa.binary()), ("seen", pa.binary()), ("tokens", pa.binary())]
)
_WIDTHS = ("<u1", "<u2", "<u4", "<u8")


def pack_ints(values: np.ndarray) -> bytes:
    """Numbers from 0 on in the least width that holds them all, lowest bytes of all first, with zstd where that is less."""
    top = int(values.max()) if len(values) else 0
    kind = next(k for k in range(4) if top < 1 << (8 << k))
    planes = values.astype(_WIDTHS[kind]).view(np.uint8).reshape(-1, 1 << kind).T.tobytes()
    if len(planes) > 64:
        less = pa.compress(planes, "zstd", asbytes=True)
        if len(less) + 8 < len(planes):
            return bytes([kind + 4]) + len(values).to_bytes(8, "little") + less
    return bytes([kind]) + planes


def packed_size(body: bytes) -> int:
    """How many numbers `pack_ints` was given."""
    return int.from_bytes(body[1:9], "little") if body[0] >= 4 else (len(body) - 1) >> body[0]


def unpack_ints(body: bytes) -> np.ndarray:
    kind, n = body[0] % 4, packed_size(body)
    planes = pa.decompress(memoryview(body)[9:], n << kind, "zstd") if body[0] >= 4 else memoryview(body)[1:]
    out = np.empty((n, 1 << kind), np.uint8)
    out[:] = np.frombuffer(planes, np.uint8).reshape(1 << kind, n).T
    return out.view(_WIDTHS[kind]).ravel().astype(np.int64)


def ordered(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by the first key, then the next: one sort where the numbers fit into one."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    spans = [int(k.max()) + 1 for k in keys]
    if math.prod(spans) >= 1 << 63:
        return np.lexsort(keys[::-1])
    one = keys[0].astype(np.int64)
    for key, span in zip(keys[1:], spans[1:]):
        one = one * span + key
    return np.argsort(one)


def chunks(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """`CHUNK`: runs of whole documents as numbers into their own word list, with training counts of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        for batch in small(batches, "text", CHUNK_BYTES):
            hashes, bounds = word_hashes(batch.column("text"))
            tokens = np.insert(hashes, bounds[1:], END[0])
            n_tokens = np.diff(bounds) + 1
            words, local = np.unique(tokens, return_inverse=True)
            held = np.array(batch.column("held"))
            seen = np.bincount(local[~np.repeat(held, n_tokens)], minlength=len(words))
            yield pa.record_batch(
                [
                    pa.array([name]),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([held.tolist()], pa.list_(pa.bool_())),
                    pa.array([pack_ints(n_tokens)]),
                    pa.array([words.astype("<u8").tobytes()]),
                    pa.array([pack_ints(seen)]),
                    pa.array([pack_ints(local)]),
                ],
                schema=_CHUNK,
            )
            name += 1

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return mapped(rows, run, CHUNK)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """All messages to one shard at a time; they arrive in that order."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["shard"] != held[0]["shard"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _send(rows: DataFrame, shards: int) -> DataFrame:
    return rows.repartitionById(shards, F.col("shard"))


def word_counts(all_chunks: DataFrame, shards: int) -> DataFrame:
    """chunk, shard, ids, counts: what the corpus knows of each chunk's words, in the order of its word list.

    Ids count from 1 in each shard's order of frequency, so frequent words have small ones (0: not in training). Rows of chunk -1 have a shard's sums: types, tokens, once, twice.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, seen = np.frombuffer(row["words"], "<u8"), unpack_ints(row["seen"])
                shard = _shard_of(words, shards)
                cuts = np.searchsorted(shard, np.arange(shards + 1))
                some = np.flatnonzero(np.diff(cuts))
                slices = [(int(s), words[cuts[s] : cuts[s + 1]].tobytes(), pack_ints(seen[cuts[s] : cuts[s + 1]])) for s in some]
                yield pa.record_batch(
                    [pa.array([s for s, _, _ in slices], pa.int32()), pa.array([row["chunk"]] * len(slices), pa.int64()), pa.array([w for _, w, _ in slices], pa.binary()), pa.array([c for _, _, c in slices], pa.binary())],
                    names=["shard", "chunk", "words", "seen"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for messages in _by_shard(batches):
            shard = messages[0]["shard"]
            parts = [np.frombuffer(m["words"], "<u8") for m in messages]
            every, back = np.unique(np.concatenate(parts), return_inverse=True)
            counts = np.bincount(back, np.concatenate([unpack_ints(m["seen"]) for m in messages]), len(every)).astype(np.int64)
            rank = np.empty(len(counts), np.int64)
            rank[np.argsort(-counts, kind="stable")] = np.arange(1, len(counts) + 1)
            ids = np.where(counts > 0, rank * shards - shard, 0)
            cuts = np.cumsum([0, *map(len, parts)])
            mine = [back[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            n = len(messages)
            sums = [int((counts > 0).sum()), int(counts.sum()), int((counts == 1).sum()), int((counts == 2).sum())]
            yield pa.record_batch(
                [
                    pa.array([m["chunk"] for m in messages] + [-1], pa.int64()),
                    pa.array([shard] * (n + 1), pa.int32()),
                    pa.array([pack_ints(ids[x]) for x in mine] + [None], pa.binary()),
                    pa.array([pack_ints(counts[x]) for x in mine] + [None], pa.binary()),
                    *(pa.array([None] * n + [s], pa.int64()) for s in sums),
                ],
                names=["chunk", "shard", "ids", "counts", "types", "tokens", "once", "twice"],
            )

    asked = mapped(all_chunks.select("chunk", "words", "seen"), ask, "shard int, chunk long, words binary, seen binary")
    return mapped(
        _send(asked, shards), answer, "chunk long, shard int, ids binary, counts binary, types long, tokens long, once long, twice long"
    )


class _Grams:
    """The distinct bigrams and trigrams of a chunk that training may know, ordered by shard, context and word.

    A trigram is a bigram and the word that follows it, and goes where the bigram goes.
    """

    def __init__(self, row: dict, shards: int) -> None:
        known = sorted(row["known"], key=lambda x: x["shard"])
        ids = np.concatenate([unpack_ints(x["ids"]) for x in known])
        self.counts = np.concatenate([unpack_ints(x["counts"]) for x in known])
        words = np.frombuffer(row["words"], "<u8")
        self.tokens, self.n_tokens = unpack_ints(row["tokens"]), unpack_ints(row["n_tokens"])
        self.stops = np.cumsum(self.n_tokens)
        self.starts = self.stops - self.n_tokens
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = np.searchsorted(words, END[0])
        keys, entry = np.unique(before * len(words) + self.tokens, return_inverse=True)
        self.entry_of = entry.astype(np.int32)
        context, word = keys // len(words), keys % len(words)
        self.context_of, self.word_of = context.astype(np.int32), word.astype(np.int32)
        self.n_entries = len(keys)
        del before, keys, entry
        use = np.flatnonzero((ids[context] > 0) & (ids[word] > 0))
        self.context, self.word = ids[context[use]], ids[word[use]]
        self.of_context = self.counts[context[use]]
        with np.errstate(over="ignore"):
            part = mix(words[word[use]]) % (self.of_context // SPLIT + 1).astype(np.uint64)
            shard = _shard_of(mix(words[context[use]] + mix(part)), shards)
        order = ordered(shard, self.context, self.word)
        self.use = use[order]
        self.context, self.word, self.of_context = (x[order] for x in (self.context, self.word, self.of_context))
        self.cuts = np.searchsorted(shard[order], np.arange(shards + 1))

        # The first token of a document has no bigram before it, so no trigram ends there.
        later = np.ones(len(self.tokens), bool)
        later[self.starts] = False
        self.later = np.flatnonzero(later)
        keys, tri = np.unique(self.entry_of[self.later - 1].astype(np.int64) * len(words) + self.tokens[self.later], return_inverse=True)
        self.tri_of, self.n_tri = tri.astype(np.int32), len(keys)
        place = np.full(self.n_entries, -1, np.int64)
        place[self.use] = np.arange(len(self.use))
        place, third = place[keys // max(len(words), 1)], ids[keys % max(len(words), 1)]
        use = np.flatnonzero((place >= 0) & (third > 0))
        self.use3 = use[ordered(place[use], third[use])]
        self.third = third[self.use3]
        self.width3 = np.bincount(place[self.use3], minlength=len(self.use))
        self.cuts3 = np.append(0, np.cumsum(self.width3))[self.cuts]

    def training_counts(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        learnt = ~np.repeat(held, self.n_tokens)
        pairs = np.bincount(self.entry_of[learnt], minlength=self.n_entries)[self.use]
        return pairs, np.bincount(self.tri_of[learnt[self.later]], minlength=self.n_tri)[self.use3]


_ASKED = ("contexts", "totals", "widths", "words", "seen", "widths3", "words3", "seen3")


def gram_requests(known_chunks: DataFrame, shards: int) -> DataFrame:
    """shard, chunk, and the chunk's n-grams there: contexts with their counts, how many words each, words, counts,
    and for each of these bigrams how many words follow it, these words, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = _Grams(row, shards)
                counts, counts3 = grams.training_counts(np.array(row["held"]))
                out: list[tuple] = []
                for s in np.flatnonzero(np.diff(grams.cuts)).tolist():
                    a, b = grams.cuts[s], grams.cuts[s + 1]
                    c, d = grams.cuts3[s], grams.cuts3[s + 1]
                    context = grams.context[a:b]
                    heads = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                    pairs = context[heads], grams.of_context[a:b][heads], np.diff(np.append(heads, b - a)), grams.word[a:b], counts[a:b]
                    out.append((s, row["chunk"], *map(pack_ints, (*pairs, grams.width3[a:b], grams.third[c:d], counts3[c:d]))))
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * len(_ASKED)]
                columns = list(zip(*out)) if out else [[]] * len(kinds)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "chunk", *_ASKED])

    return mapped(known_chunks, run, "shard int, chunk long, " + ", ".join(f"{name} binary" for name in _ASKED))


def weight(total: np.ndarray) -> np.ndarray:
    """How much of a word's probability its context says, by the context's count; the rest is that of the shorter context."""
    return WEIGHT * total / (total + 1.0)


def coded(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The weighted share of a word in its context, as a step of its logarithm."""
    return np.minimum(np.round(-np.log10(weight(total) * seen / total) * STEPS), ABSENT - 1)


def shares(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == ABSENT, 0.0, 10.0 ** (-codes.astype(float) / STEPS))


def build_trie(context: np.ndarray, word: np.ndarray, seen: np.ndarray, total: np.ndarray, pair: np.ndarray, third: np.ndarray, seen3: np.ndarray) -> Trie:
    """The trie of the n-grams seen in training, from different ones in order with their counts; `pair` numbers bigrams."""
    keep, keep3 = seen > 0, seen3 > 0
    pair, third, seen3 = pair[keep3], third[keep3], seen3[keep3]
    widths = np.bincount(pair, minlength=len(seen))[keep]
    codes = coded(seen[keep], total[keep].astype(float))
    return Trie.of(context[keep], word[keep], codes, (widths, third, coded(seen3, seen[pair])))


def _distinct(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different pair is first, in order, and the number of each pair among these."""
    order = ordered(context, word)
    context, word = context[order], word[order]
    first = np.ones(len(order), bool)
    first[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(first) - 1
    return order[first], which


def gram_answers(requests: DataFrame, shards: int) -> DataFrame:
    """chunk, shard, codes, codes3: of each requested bigram and trigram, from the shard's trie.

    The tries are kept: a row of chunk -1 has the levels of its shard, as `Trie.from_buffer` reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for messages in _by_shard(batches):
            def every(name: str) -> np.ndarray:
                return np.concatenate([unpack_ints(m[name]) for m in messages])

            widths, words, thirds = every("widths"), every("words"), every("words3")
            one, which = _distinct(np.repeat(every("contexts"), widths), words)
            context, total = (np.repeat(every(name), widths)[one] for name in ("contexts", "totals"))
            seen = np.bincount(which, every("seen"), len(one))
            pairs = np.repeat(which, every("widths3"))
            one3, which3 = _distinct(pairs, thirds)
            seen3 = np.bincount(which3, every("seen3"), len(one3))
            word, pair, third = words[one], pairs[one3], thirds[one3]
            levels = build_trie(context, word, seen, total, pair, third, seen3).to_bytes()
            trie = Trie.from_buffer(levels)
            place = trie.levels[0].find(trie.roots(context), word)
            place3 = trie.levels[1].find(place[pair], third)
            codes, codes3 = trie.codes(2, place, ABSENT)[which], trie.codes(3, place3, ABSENT)[which3]

            def cut(name: str, values: np.ndarray) -> list[bytes]:
                cuts = np.cumsum([0, *(packed_size(m[name]) for m in messages)])
                return [pack_ints(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]

            yield pa.record_batch(
                [
                    pa.array([*(m["chunk"] for m in messages), -1], pa.int64()),
                    pa.array([messages[0]["shard"]] * (len(messages) + 1), pa.int32()),
                    pa.array([*cut("words", codes), None], pa.binary()),
                    pa.array([*cut("words3", codes3), None], pa.binary()),
                    pa.array([None] * len(messages) + [levels], pa.binary()),
                ],
                names=["chunk", "shard", "codes", "codes3", "levels"],
            )

    return mapped(_send(requests, shards), run, "chunk long, shard int, codes binary, codes3 binary, levels binary")


def _scores(answered: DataFrame, shards: int, n: int, types: int, discount: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = _Grams(row, shards)
                c = grams.counts.astype(float)
                alone = np.where(c > 0, (c - discount) / max(n, 1), discount * types / n if n else 1.0)
                codes, codes3 = np.full(grams.n_entries, ABSENT, np.uint16), np.full(grams.n_tri, ABSENT, np.uint16)
                answers = sorted(row["answers"] or [], key=lambda x: x["shard"])
                if answers:
                    codes[grams.use] = np.concatenate([unpack_ints(a["codes"]) for a in answers])
                    codes3[grams.use3] = np.concatenate([unpack_ints(a["codes3"]) for a in answers])
                # Worked out once for each different n-gram or word, then gathered.
                says, share = weight(c), shares(codes)
                pair = share + (1 - says)[grams.context_of] * alone[grams.word_of]
                # A bigram's count is its share of its context's count: exact up to 1700, then within a step of the code.
                seen = np.round(share * c[grams.context_of] / np.where(says > 0, says, 1.0)[grams.context_of])
                rest = 1 - weight(seen)
                chance = pair[grams.entry_of]
                chance[grams.later] = shares(codes3)[grams.tri_of] + rest[grams.entry_of[grams.later - 1]] * chance[grams.later]
                base = np.log10((c + 1) / (n + types + 1))
                sums = [np.add.reduceat(x, grams.starts) for x in (base[grams.tokens], np.log10(chance), (c > 0).astype(np.int64)[grams.tokens])]
                yield pa.record_batch(
                    [
                        pa.array(row["doc_id"], pa.int64()),
                        pa.array(row["held"], pa.bool_()),
                        pa.array(grams.n_tokens),
                        pa.array(sums[2]),
                        pa.array(np.full(len(grams.starts), n, np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return mapped(
        answered, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are the words of the whole text with A-Z lower-cased, then one end token. The model is learnt from documents
    for which `held_out` is not true: a trigram's share of its context, interpolated by the context's count with the
    bigram's share of its own, and that with the discounted share of the word alone, all of whose discount goes to
    unknown words. A text begins after an end token. base_score adds one to each count.

    Documents become chunks, a bucketed table below the shared folder, so their tokens are never shuffled (its name is
    in the session's catalog only while the job is put together, so that must allow tables). A chunk asks the unigram shards for
    counts and ids of its distinct words, then the shards of n-grams for its distinct bigrams and trigrams, with its own training counts
    in the same message; a shard adds up, builds its Elias-Fano trie, and answers each chunk by successor search. The
    tries are written with the answers, below the shared folder. Messages
    are arrays, pre-aggregated in the chunk; words go to shards by hash and contexts of many occurrences are split by
    successor, so no shard grows with a frequent word. Words are 64-bit hashes; two of a corpus of 10^9 different words
    are taken for one with a chance of about 3 in 100. Only the sums N, V and counts of counts go through the driver.

    A null text is the end token alone, a null id or `held_out` counts as training, repeated rows count each, other
    columns are ignored. Without training documents every token has the same probability 1.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    buckets = min(most, max(8, -(-size // (2 * CHUNK_BYTES))))  # of more text a bucket has more chunks
    name = f"chunks_{uuid.uuid4().hex}"
    made = chunks(docs, held_out, id_col, text_col).write.bucketBy(buckets, "chunk").option("compression", "zstd")
    made.option("path", shared_folder(spark, "chunks")).saveAsTable(name)
    all_chunks = spark.table(name)
    entries = all_chunks.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    words = written(word_counts(all_chunks, int(entries // WORD_SHARD) + 1), "word-counts")
    sums = words.filter("chunk = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "tokens", "once", "twice"))).first()
    types, n, once, twice = map(int, sums)
    discount = once / (once + 2 * twice) if once + twice else 0.5
    shards = n // PAIR_SHARD + 1
    known = (
        words.filter("chunk >= 0")
        .repartition(buckets, "chunk")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("shard", "ids", "counts")).alias("known"))
    )
    known_chunks = all_chunks.join(known, "chunk")
    answers = written(gram_answers(gram_requests(known_chunks, shards), shards), "gram-codes").filter("chunk >= 0")
    given = answers.repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("shard", "codes", "codes3")).alias("answers"))
    scored = _scores(known_chunks.join(given, "chunk", "left"), shards, n, types, discount)
    spark.sql(f"DROP TABLE {name}")  # the name only: files of an external table stay, and the plan has them
    return scored
