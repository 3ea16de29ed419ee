"""All registered queries of the base library, and SQL to hold them against."""

from __future__ import annotations

from tabulon.plans import elementwise, more, strings, tables

QUERIES = tables.QUERIES | elementwise.QUERIES | strings.QUERIES | more.QUERIES
SQL = tables.SQL | elementwise.SQL | strings.SQL | more.SQL
