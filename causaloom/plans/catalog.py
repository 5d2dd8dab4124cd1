"""Registry of the library's named queries."""

from __future__ import annotations

from . import corpus, custom, evaluation, fixtures, graph, networks, packed, physics, registry  # noqa: F401  (imports register)
from .dialect import DUCK


def queries() -> dict:
    return {name: registry.query(name) for name in registry.OPERATORS} | dict(registry.CUSTOM)


def oracle_sql() -> dict:
    found = {name: registry.oracle(name) for name in registry.OPERATORS}
    return found | {name: registry.statement(body(DUCK), DUCK) for name, body in custom.ORACLES.items()}
