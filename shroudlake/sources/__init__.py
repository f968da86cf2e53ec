"""Readers and writers: files, SQL dumps and databases."""
