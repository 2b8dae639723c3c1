"""Readers and writers: journal files, the event table, rendered journals, CSV."""
