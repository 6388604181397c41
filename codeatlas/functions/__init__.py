"""Subpackage of codeatlas."""
