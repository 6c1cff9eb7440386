"""The fact tables of a set of sources: what rules, look-ups and traces read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ferrule.sources import code, triggers
from ferrule.sources.embedded_sql import embedded_sql


def fact_tables(files: DataFrame, routines: DataFrame | None = None, key: str = "path") -> dict[str, DataFrame]:
    """files (key, text) -> lazy tables by name: ``refs``, ``units``, ``endpoints``, ``triggers``, ``docs``, ``openers``, ``structures``,
    ``statements``, ``defaults``, ``schedules`` and, with a catalog of routines, ``routine_calls``.

    Null and empty texts give no rows. Each table strips the sources anew unless they have a column ``bare`` (``code.with_bare``);
    ``store.FactStore`` keeps the tables and reads changed sources only.
    """
    rows = code.with_unit(code.source_lines(files, key), key)
    out = {
        "refs": code.named(rows, key),
        "units": code.units(rows, key),
        "endpoints": code.endpoints(files, key),
        "triggers": code.execution_triggers(files, key),
        "docs": code.doc_blocks(files, key),
        "openers": code.environment_openers(files, key),
        "structures": code.service_structures(files, key),
        "statements": embedded_sql(files, key),
        "defaults": code.parameter_reads(files, key),
        "schedules": triggers.schedules(rows, key),
    }
    if routines is not None:
        out["routine_calls"] = code.routine_calls(files, routines, key)
    return out
