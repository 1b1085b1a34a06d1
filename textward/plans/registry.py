"""All registered queries: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.tables import plain_integers
from . import access, conversations, observability, policies, streams, texts

MODULES = (texts, policies, conversations, access, observability, streams)


def _widened(fn: Callable) -> Callable:
    def run(spark, sf_dir):
        return plain_integers(fn(spark, sf_dir))

    run.__name__, run.__doc__, run.__module__ = fn.__name__, fn.__doc__, fn.__module__
    return run


REGISTRY: dict[str, tuple[Callable, str | None]] = {
    name: (_widened(fn), sql) for module in MODULES for name, (fn, sql) in module.QUERIES.items()
}
