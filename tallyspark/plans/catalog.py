"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import evaluation, leagues, pipelines, relations, studies, windows

_FAMILIES = (windows, relations, evaluation, pipelines, leagues, studies)

QUERIES: dict = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLES: dict = {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
