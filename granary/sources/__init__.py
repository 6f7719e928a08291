"""Part of the granary engine: sources."""
