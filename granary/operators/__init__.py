"""Part of the granary engine: operators."""
