"""Readers and writers of matrix folders and tables."""
