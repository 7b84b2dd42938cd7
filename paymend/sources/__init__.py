"""Readers, event parsing and table maintenance."""
