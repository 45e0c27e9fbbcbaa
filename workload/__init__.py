"""Queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from workload import aggregates, joins, layers, prep, results, scalars, scenes, sources, windows

MODULES = [sources, scalars, aggregates, windows, joins, layers, prep, results, scenes]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
