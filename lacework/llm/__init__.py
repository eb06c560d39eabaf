"""Training-data operators: scoring, scanning, deduplication, decontamination and mixing.

Nothing else in the library imports this subpackage.
"""
