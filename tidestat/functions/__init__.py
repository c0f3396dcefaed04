"""Column and table functions that statistics share."""
