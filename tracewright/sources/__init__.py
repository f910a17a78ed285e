"""Readers and writers of the file formats around a trace."""
