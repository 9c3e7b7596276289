"""queries() and their DuckDB oracles, one entry per operator."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: f(spark, sf_dir) becomes the query `name`, checked against `oracle`."""

    def add(f):
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    from rosterlake.plans import lifecycle, reading, texts  # noqa: F401  modules register as they load


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
