"""Readers: directories, symbol indexes, converters."""
