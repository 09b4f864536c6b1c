"""Sources and sinks: table scans, knowledge-base scan, model/vector sinks."""
from offerlab.sources.tables import Tables, load_tables, load_csv_tables, read_table

__all__ = ["Tables", "load_tables", "load_csv_tables", "read_table"]
