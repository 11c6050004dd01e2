"""Job states: native to unified and back, and state predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobfacts import fixed_values as fv


def lookup(table: dict[str, str], key: Column) -> Column:
    """The entry of a literal table, NULL for a key without one."""
    pairs = ", ".join(repr(x) for item in table.items() for x in item)
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def slurm_state(native: Column) -> Column:
    """Unified state of a Slurm job; a state without an entry stays as it is."""
    return F.coalesce(lookup(fv.SLURM_STATES, native), native)


def flux_state(native: Column, result: Column | None = None) -> Column:
    """Unified state of a Flux job; INACTIVE is resolved by the job's result."""
    by_state = F.coalesce(lookup(fv.FLUX_STATES, native), native)
    if result is None:
        return by_state
    resolved = F.coalesce(lookup(fv.FLUX_RESULTS, result), by_state)
    return F.when(native == "INACTIVE", resolved).otherwise(by_state)


def unified_state(backend: Column, native: Column, result: Column) -> Column:
    """State of a job in a table that mixes both schedulers."""
    return F.when(backend == "flux", flux_state(native, result)).otherwise(slurm_state(native))


def native_states(state: str, backend: str) -> list[str]:
    """The native states a unified state covers, for filters that reach the scan."""
    table = fv.SLURM_STATES if backend == "slurm" else fv.FLUX_STATES
    found = [native for native, unified in table.items() if unified == state]
    if backend == "flux" and state in fv.FLUX_RESULTS.values() and "INACTIVE" not in found:
        found.append("INACTIVE")
    return found or [state]


def native_state_filter(
    state: str, backend: Column, native: Column, result: Column
) -> Column:
    """Rows of a native table in a unified state, as plain comparisons on stored columns."""
    slurm = (backend == "slurm") & native.isin(native_states(state, "slurm"))
    flux_names = [s for s in native_states(state, "flux") if s != "INACTIVE"]
    flux = native.isin(flux_names) if flux_names else F.lit(False)
    results = [r for r, unified in fv.FLUX_RESULTS.items() if unified == state]
    if state == "COMPLETED":
        others = [r for r, unified in fv.FLUX_RESULTS.items() if unified != state]
        ended = (native == "INACTIVE") & (result.isNull() | ~result.isin(others))
        flux = flux | ended
    elif results:
        flux = flux | ((native == "INACTIVE") & result.isin(results))
    return slurm | ((backend == "flux") & flux)


def is_terminal(state: Column) -> Column:
    return state.isin(fv.TERMINAL_STATES)


def first_state(text: Column) -> Column:
    """First entry when the state came as a JSON list, else the text itself."""
    return F.when(text.startswith("["), F.get_json_object(text, "$[0]")).otherwise(text)


def joined_state(text: Column) -> Column:
    """All entries of a state list, comma-joined; plain text stays as it is."""
    listed = F.from_json(text, "array<string>")
    return F.when(text.startswith("["), F.array_join(listed, ",")).otherwise(text)


def is_ready(
    phase: Column, size: Column, desired: Column, conditions: Column
) -> Column:
    """MiniCluster readiness by phase, by size or by a condition that is true."""
    by_phase = F.coalesce(phase.isin(fv.READY_PHASES), F.lit(False))
    by_size = F.coalesce((size > 0) & (desired > 0) & (size >= desired), F.lit(False))
    by_condition = F.exists(
        F.coalesce(conditions, F.array().cast("array<struct<type:string,status:string>>")),
        lambda c: (c["status"] == "True") & c["type"].isin(fv.READY_CONDITIONS),
    )
    return by_phase | by_size | F.coalesce(by_condition, F.lit(False))


def desired_size(maximum: Column, desired: Column, spec: Column) -> Column:
    """First size that is set; zero counts as not set."""
    zero = F.lit(0)
    return F.coalesce(F.nullif(maximum, zero), F.nullif(desired, zero), F.nullif(spec, zero))
