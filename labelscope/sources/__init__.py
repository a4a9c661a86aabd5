"""Sources and sinks (S1-S6) and the fixture views over the driver tables."""

from labelscope.sources.tables import (read_table, read_tsv, write_parquet,
                                       write_csv_report, table_path)

__all__ = ["read_table", "read_tsv", "write_parquet", "write_csv_report", "table_path"]
