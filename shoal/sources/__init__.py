"""Readers and row formats."""
