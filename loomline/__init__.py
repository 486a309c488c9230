"""loomline: SQL-file pipelines with lineage, and large-scale table operators, on PySpark."""

__version__ = "0.1.0"
