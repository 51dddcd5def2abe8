"""Relational operators on spans, entities and measures."""
