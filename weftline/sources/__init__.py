"""Readers and writers: catalog tables, API descriptions, REST collections."""
