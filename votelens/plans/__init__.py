"""Registered queries over the given tables, each with its SQL where one exists."""

import importlib

MODULES = ("labels_q", "votes_q", "curves_q", "audit_q", "pool_q", "sweeps_q", "resample_q", "io_q", "models_q", "stream_q")


def load_all():
    registry = importlib.import_module("votelens.plans.registry")
    for m in MODULES:
        try:
            importlib.import_module(f"votelens.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"votelens.plans.{m}":
                raise
    return registry
