"""Queries and SQL of the training-data operators, for __spark_entry__.py."""

from importlib import import_module

MODULES = ("simhash", "urlfilter", "linededup", "mixing", "packing", "toxicity", "langid", "lm", "embdedup", "ann", "resample", "repair", "sharding")


def _merged(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), name).items()}


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
