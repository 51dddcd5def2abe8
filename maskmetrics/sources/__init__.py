"""Readers and writers of corpora, annotations, anonymizations and results."""
