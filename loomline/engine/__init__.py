"""Tasks in SQL files: reading, ordering, running, lineage, state."""
