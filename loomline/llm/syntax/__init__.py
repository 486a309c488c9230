"""Hand-written parsers that only judge syntax: recursive-descent statements, precedence-climbing expressions,
panic-mode recovery. Each `parse_...` returns all faults of a text in order; none means that it parses."""
