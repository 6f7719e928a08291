"""Part of the granary engine: plans."""
