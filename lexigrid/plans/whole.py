"""The sparse queries over the whole vocabulary: no token goes before windows are formed."""

from __future__ import annotations

from inspect import signature

from lexigrid.plans import catalogue, models

QUERIES: dict = {}
#: Those of the catalogue have the twin of the limited query without its limit; DuckDB is too slow for vectors on every cell.
ORACLE_SQL: dict = {}


def _whole(name: str, run):
    def whole(spark, sf_dir):
        return run(spark, sf_dir, size=None)

    whole.__name__ = whole.__qualname__ = name
    return whole


for _module in (catalogue, models):
    for _name, _run in _module.QUERIES.items():
        if "size" not in signature(_run).parameters:
            continue
        QUERIES[f"{_name}_whole"] = _whole(f"{_name}_whole", _run)
        if signature(_run).parameters["size"].default == catalogue.VOCABULARY:
            ORACLE_SQL[f"{_name}_whole"] = _module.ORACLE_SQL[_name].replace(f" ORDER BY n DESC, token LIMIT {catalogue.VOCABULARY})", ")")
