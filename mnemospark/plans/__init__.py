"""Queries over the driver's tables: the views that stand in for a memory store, and a catalogue with SQL to compare with."""
