"""A mixture of sources at target weights, drawn by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfacts.llm.common import written
from jobfacts.llm.running import running_sums

#: Expected copies are whole numbers of 2^-40, so that sums are exact in any order and partitioning.
UNIT = 1 << 40
_BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """How many runs of characters other than blanks (space, tab to carriage return) a text has; null has none."""
    stripped = F.ltrim(text, F.lit(_BLANKS))
    return F.coalesce(F.length(F.regexp_replace(stripped, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """source, source_size, target for `sizes` (source, source_size; one row a source).

    Sources, by code point and null last, have `weights` in turn and divide `share` of the sum of all sizes; a target
    stops at `limit` times its source's size, and what is over goes to the others by weight until none is above. The
    price of one unit of weight only rises, so a round needs two sums, which are all that the driver sees.
    """
    order = [F.col("source").asc_nulls_last()]
    ranked = running_sums(sizes, F.lit(0), order, F.lit(1), UNIT)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    known = written(ranked.select("source", "source_size", turn.alias("weight"), (F.col("source_size") * limit).alias("cap")), "sources")
    budget = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    price, before = 0.0, None
    while price != before:
        above = F.lit(price) * F.col("weight") > F.col("cap")
        full, rest = known.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))
        ).first()
        before, price = price, (budget - full) / rest if rest else price
    return known.select("source", "source_size", F.least("cap", F.lit(price) * F.col("weight")).alias("target"))


def mixture(
    docs: DataFrame,
    weights: tuple[int, ...] = (1,),
    share: float = 1.0,
    limit: float = 1.0,
    seed: int = 0,
    carry: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The columns `carry` of each row (all of them by default), with size, source_size, target and copies.

    size is the number of words of the text; each source's sizes times copies come near its target (see `targets`).
    A document of a source is expected in target / source_size copies. In each source the expected copies are summed
    up over the documents in order, a random offset (from `seed` and the source's name) is added, and a document is
    taken once for each whole number that the sum crosses on it: the whole part of its expectation, or one more. The order
    is by size, then by a hash of the id, so what a source takes misses its target by less than its largest document.
    Seed, ids, texts and sources decide alone: runs agree however the rows are partitioned.

    A source that holds most of the rows is cut into ranges of that order like any other; the sources' table joins the
    rows by size or in a join that adaptive execution may split. With no columns carried but the id, texts are
    not shuffled.

    A null text has no words and may be taken or not; a null source is a source; null ids and repeated rows are rows
    like any other (among equal rows it makes no difference which is taken once more). Sources without words have
    target 0 and no copies. No rows give no rows. Columns of other names are carried as they are, but the four named
    above, which are replaced.
    """
    made = ["size", "source_size", "target", "copies"]
    carried = [c for c in (docs.columns if carry is None else carry) if c not in made]
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = written(
        docs.select(
            *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)],
            F.col(source_col).alias("source"),
            words(F.col(text_col)).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), ident)).alias("tie"),
            F.xxhash64(text_col).alias("text_tie"),
        ),
        "mixing",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = written(targets(sizes, weights, share, limit), "targets")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("to_source", F.lit("")))), 1, 10), 16, 10).cast("long")
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(F.lit(0))
    known = known.select(
        F.col("source").alias("to_source"), "source_size", "target", expected.cast("long").alias("expected")
    ).withColumn("random", offset)
    joined = rows.join(known, rows["source"].eqNullSafe(known["to_source"]), "left")
    order = [F.col("source").asc_nulls_last(), *[F.col(c) for c in ("size", "tie", "text_tie", "nth")]]
    summed = running_sums(joined.withColumn("nth", F.monotonically_increasing_id()), F.col("source"), order, F.col("expected"), UNIT)
    copies = F.shiftright((F.col("before") + F.col("random")) % UNIT + F.col("expected"), 40)
    return summed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], "size", "source_size", "target", copies.alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The rows of a mixture, each as often as it was taken, with copy: 0, 1, ..."""
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return mixed.withColumn("copy", F.explode(copies)).drop("copies")
