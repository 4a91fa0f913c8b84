"""Readers and writers of count tables, intervals and results."""
