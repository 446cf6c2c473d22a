"""Tables and side inputs."""

from .tables import from_rows, read_table, ship_file, shipped

__all__ = ["from_rows", "read_table", "ship_file", "shipped"]
