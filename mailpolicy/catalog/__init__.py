"""Registered queries: name → Spark query and, where SQL can say it, the same answer from the base columns.

Inputs are text lines that Spark derives from the given tables (``fixtures``), read by the real parsers. The SQL never
builds or parses that text.
"""

from mailpolicy.catalog import curve_queries, log_queries, report_queries, scan_queries, stored_queries, text_queries, typed_queries

_MODULES = (scan_queries, report_queries, curve_queries, log_queries, text_queries, typed_queries, stored_queries)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}
