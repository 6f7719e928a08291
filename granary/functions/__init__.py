"""Part of the granary engine: functions."""
