"""Part of the symgraph analytics engine."""
