"""The catalogue of named queries, each beside the SQL that an independent engine runs for the same rows."""

from millrace.plans import catalog


def all_queries():
    """(queries, SQL) of every module of the catalogue."""
    from millrace.plans import analytics, columns, graphs, io, operators, relational  # noqa: F401

    return catalog.QUERIES, catalog.SQL
