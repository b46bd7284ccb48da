"""Readers, writers and the stand-in tables derived from the shared test data."""

from tessera.sources.files import (read_csv, read_json_lines, read_pipe_table, read_table,
                                   wide_schema, write_table)
from tessera.sources.tables import TABLES, load, register_views

__all__ = ["TABLES", "load", "register_views", "read_csv", "read_json_lines",
           "read_pipe_table", "read_table", "wide_schema", "write_table"]
