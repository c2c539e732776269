"""Sources and sinks: JSON items, and the Parquet store of entities."""
