"""Readers and adapters that produce the engine's relations."""
