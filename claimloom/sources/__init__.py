"""Readers of the engine's input formats."""
