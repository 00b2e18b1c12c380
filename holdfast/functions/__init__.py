"""Column builders: text measures, scorers, verdict parsing, turn metrics."""
