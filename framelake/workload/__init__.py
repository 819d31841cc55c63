"""The registered queries, one module per family."""

from __future__ import annotations

import importlib

FAMILIES = ["pixels", "stencils", "records", "signals", "corpora"]


def _load():
    for family in FAMILIES:
        importlib.import_module(f"framelake.workload.{family}")
    from framelake.workload import registry

    return registry


def queries():
    return dict(_load().QUERIES)


def oracles():
    return dict(_load().ORACLES)
