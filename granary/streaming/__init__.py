"""Part of the granary engine: streaming."""
