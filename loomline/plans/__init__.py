"""Catalyst plans as Python trees, and what is read from them: inputs, outputs, column lineage."""
