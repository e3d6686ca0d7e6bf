"""Readers and writers: JSON records, run files, tables, images and vector stores."""
