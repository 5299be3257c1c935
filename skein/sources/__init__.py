"""Readers, ground-truth parsers, catalogs and sinks."""
