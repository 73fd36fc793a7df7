"""The named queries. `load_all` imports every family once and returns (queries, SQL twins)."""

from importlib import import_module

FAMILIES = ["extraction", "splitting", "profiling", "scoring", "triaging", "modeling"]


def load_all():
    for family in FAMILIES:
        import_module(f"hostlens.plans.{family}")
    from hostlens.plans.catalogue import ORACLES, QUERIES

    return QUERIES, ORACLES
