import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from jobfacts.llm import mixing

UNIT = 1 << 40


def brute(rows, weights, share, limit, seed):
    """Targets and copies of (doc_id, text, source) rows, one after the other."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    of = defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        of[s] += n
    names = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = set(), share * sum(of.values())
    while True:
        rest = [s for s in names if s not in full]
        price = (left - sum(limit * of[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        above = {s for s in rest if price * weight[s] > limit * of[s]}
        if not above:
            break
        full |= above
    target = {s: limit * of[s] if s in full else price * weight[s] for s in names}

    def digest(x):
        return hashlib.md5(f"{seed}:{'' if x is None else x}".encode()).hexdigest()

    out = []
    for s in names:
        at = int(digest(s)[:10], 16)
        step = int(target[s] / of[s] * UNIT) if of[s] else 0
        mine = sorted((size[i], digest(rows[i][0]), rows[i][0]) for i in range(len(rows)) if rows[i][2] == s)
        for n, _, doc in mine:
            out.append((doc is None, doc or 0, n, of[s], target[s], at % UNIT + step >> 40))
            at += step
    return sorted(out)


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source_size, r.target, r.copies) for r in df.collect())


def test_against_brute_force(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    for weights, share, limit, seed in (((3, 1, 2), 1.5, 2.0, 0), ((1,), 0.3, 1.0, 5), ((1, 50), 2.9, 3.0, 1), ((2, 1), 7.0, 2.0, 0)):
        mixed = mixing.mixture(docs, weights, share, limit, seed, carry=["doc_id"])
        assert got(mixed) == brute(rows, weights, share, limit, seed)


def test_sources_come_near_their_targets_and_runs_agree(spark):
    rows = [(i, "w " * (i * 7919 % 97), f"s{i % 3}" if i % 2 else "hot") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (mixing.mixture(d, (3, 1, 2), 1.5, 2.0) for d in (docs.repartition(7), docs.repartition(3, "text")))
    assert got(first) == got(again)
    per = first.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most"))
    assert all(abs(r.taken - r.target) < 97 and r.most <= 2 for r in per.collect())


def test_real_output_and_clashing_names(docs):
    mixed = mixing.mixture(docs.withColumns({"target": F.lit("x"), "before": F.lit("y")}), (1, 2), 1.5, 2.0)
    assert set(docs.columns) - {"size"} < set(mixed.columns) and {r.before for r in mixed.select("before").collect()} == {"y"}
    taken = mixing.emitted(mixed)
    counts = {(r.doc_id, r.text): r.n for r in taken.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    want = {(r.doc_id, r.text): r.n for r in mixed.groupBy("doc_id", "text").agg(F.sum("copies").alias("n")).collect() if r.n}
    assert counts == want and max(r.copy for r in taken.collect()) <= 1


def test_nothing(nothing, docs):
    assert mixing.mixture(nothing).collect() == []
    wordless = mixing.mixture(docs.withColumn("text", F.lit(None).cast("string")), (1,), 1.5, 2.0)
    assert {(r.size, r.target, r.copies) for r in wordless.collect()} == {(0, 0.0, 0)}


def test_sums_run_over_ranges_and_groups(spark):
    from jobfacts.llm.running import running_sums

    rows = [(i % 5 if i % 5 else None, i, i * 37 % 11) for i in range(3000)] + [(9, i, i % 7) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")  # a group goes on over whole batches
    df = spark.createDataFrame(rows, "g long, i long, n long")
    order = [F.col("g").asc_nulls_first(), F.col("i")]
    out = running_sums(df, F.col("g"), order, F.col("n"), 1000)
    sums, want = defaultdict(int), set()
    for g, i, n in rows:
        want.add((g, i, sums[g] % 1000))
        sums[g] += n
    try:
        assert {(r.g, r.i, r.before) for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
