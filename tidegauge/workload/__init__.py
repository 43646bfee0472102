"""The registered queries: each operator over the whole of the given tables, with the SQL it must agree with."""

from __future__ import annotations

from tidegauge.workload import analyses, exploration, history, models, packs, personal, profiling, shaping

MODULES = (profiling, shaping, exploration, analyses, packs, personal, history, models)


def all_queries() -> dict:
    found = {}
    for module in MODULES:
        clash = found.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        found.update(module.QUERIES)
    return found


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
