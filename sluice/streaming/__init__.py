"""Incremental processing of exports that arrive in a folder."""
