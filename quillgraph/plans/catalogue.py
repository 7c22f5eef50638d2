"""All queries of the engine by name, with the SQL that gives the same rows.

The tables at hand stand for those of an encyclopedia: order lines are links from orders to parts, parts are articles
with categories, events are page views, documents are article texts. Each query reads its tables whole.
"""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


from . import q_files, q_graph, q_links, q_more, q_other, q_text  # noqa: E402, F401
