"""Table access: parquet scans, declared schemas, literal fixtures, writes."""

from quarry.sources.tables import (
    DRIVER_TABLES,
    append_rows,
    apply_schema,
    load,
    read_text_table,
    replace,
    save,
    save_bucketed,
    stage,
    stage_all,
    table,
    table_path,
)

__all__ = ["DRIVER_TABLES", "append_rows", "apply_schema", "load", "read_text_table", "replace", "save", "save_bucketed", "stage",
           "stage_all", "table", "table_path"]
