"""Ready-made queries and the SQL that each of them must equal, by topic."""

from importlib import import_module

MODULES = ("derived", "results", "texts", "models", "ops", "scalars", "relational", "intake")


def _merged(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), name).items()}


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
