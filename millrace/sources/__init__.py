"""Table readers with explicit schemas, writers, and the shared folder."""
from millrace.sources.tables import SCHEMAS, Workspace, load, new_path, read_table, shared_dir, write_table

__all__ = ["SCHEMAS", "Workspace", "load", "new_path", "read_table", "shared_dir", "write_table"]
