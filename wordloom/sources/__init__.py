"""Readers and writers of corpora, vocabularies and vector files."""
