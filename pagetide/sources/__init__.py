"""Readers and writers with their row rules."""
