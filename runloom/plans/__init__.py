"""Queries over the given tables, with the SQL that states what each returns."""


def _load() -> None:
    from runloom.plans import config, digests, expressions, graphs, history, integrity, material, products, reuse, streams  # noqa: F401


def all_queries() -> dict:
    from runloom.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    from runloom.plans.registry import SQL

    _load()
    return dict(SQL)
