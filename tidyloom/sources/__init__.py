from tidyloom.sources.tables import (
    cached_table,
    detect_separator,
    infer_types,
    load_raw,
    preview,
    read_csv,
    scan_results,
    write_csv,
    write_json,
)

__all__ = [
    "cached_table", "detect_separator", "infer_types", "load_raw", "preview", "read_csv",
    "scan_results", "write_csv", "write_json",
]
