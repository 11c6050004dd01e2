"""Numbers, sizes, names and defaults of single fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobfacts import fixed_values as fv
from jobfacts.functions.clocks import two_digits

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def unwrap_number(wrapped: Column) -> Column:
    """Value of a ``{set, number}`` struct; NULL when it says it is not set."""
    return F.when(F.coalesce(wrapped["set"], F.lit(True)), wrapped["number"])


def _plain_number(text: Column) -> Column:
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def numeric_text(text: Column) -> Column:
    """Number in a text that may also be empty, a flag or a wrapped number as JSON."""
    wrapped = F.from_json(text, "set boolean, number double")
    return F.when(text.startswith("{"), unwrap_number(wrapped)).otherwise(_plain_number(text))


def wrapped_number(text: Column, limited: bool = False) -> Column:
    """The struct that JSON text of a number stands for; a bare number or one in quotes is set."""
    kind = "set boolean, number bigint" + (", infinite boolean" if limited else "")
    number = _plain_number(F.btrim(text, F.lit('"'))).try_cast("bigint")
    parts = [number.isNotNull().alias("set"), number.alias("number")]
    plain = F.struct(*parts, *([F.lit(False).alias("infinite")] if limited else []))
    return F.when(text.startswith("{"), F.from_json(text, kind)).when(number.isNotNull(), plain)


def slurm_exit_code(text: Column) -> Column:
    """Exit code from the JSON of ``exit_code``; anything but digits is NULL.

    The code is plain, or the ``return_code`` of an object, which may itself be a
    wrapped number.
    """

    def part(path: str) -> Column:
        return F.get_json_object(text, "$.return_code" + path)

    is_set = F.coalesce(part(".set"), F.lit("true")) == "true"
    code = F.when(
        text.startswith("{"), F.coalesce(F.when(is_set, part(".number")), part(""))
    ).otherwise(text)
    return F.when(code.rlike("^[0-9]+$"), code.try_cast("int"))


def flux_exit_code(result: Column) -> Column:
    return F.when(result == "COMPLETED", F.lit(0)).when(result == "FAILED", F.lit(1))


def split_nodes(text: Column) -> Column:
    """Comma-separated node names; empty or missing is an empty list."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(text, F.lit("")) != "", F.split(text, ",")).otherwise(none)


def node_names(count: Column) -> Column:
    """``node-01`` to ``node-<count>``."""
    none = F.array().cast("array<string>")
    named = F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("node-"), two_digits(i)))
    return F.when(count >= 1, named).otherwise(none)


def job_id_for(backend: Column, native_id: Column) -> Column:
    """Job id as shown to users; Flux ids carry a prefix."""
    text = native_id.cast("string")
    return F.when(backend == "flux", F.concat(F.lit(fv.FLUX_ID_PREFIX), text)).otherwise(text)


def or_default(value: Column, default: str) -> Column:
    """The value unless it is missing or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def memory_bytes(text: Column) -> Column:
    """Bytes of ``<digits><MB|GB|TB|M|G|T>`` in any case, by powers of 1024; else NULL.

    A size beyond 64 bits is the largest number, so it compares as larger than any memory.
    """
    pattern = r"(?i)^\s*(\d+)\s*([MGT])B?\s*$"
    amount = F.regexp_extract(text, pattern, 1).try_cast("bigint")
    unit = F.upper(F.regexp_extract(text, pattern, 2))
    factor = F.when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40)
    return F.when(
        text.rlike(pattern),
        F.coalesce(F.try_multiply(amount, factor.cast("bigint")), F.lit((1 << 63) - 1)),
    )


def redact(auth: Column) -> Column:
    """The map with every secret value replaced."""
    return F.transform_values(
        auth, lambda k, v: F.when(k.isin(fv.SECRET_KEYS), F.lit(fv.REDACTED)).otherwise(v)
    )
