"""Readers and writers of the experiment files."""
