"""Sources: parquet tables of a folder, task files."""
