"""Readers and writers of the tables and file formats."""
