"""Imports every family of queries, which registers them."""

from . import (  # noqa: F401
    aggregates,
    changes,
    flagship,
    joins,
    rows,
    scalars,
    sets,
    statements,
    subqueries,
    windowed,
)

statements.add_twins()
