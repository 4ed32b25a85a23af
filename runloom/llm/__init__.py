"""Training-data operators: near-duplicates, decontamination, scoring, extraction and tokenisation.

Nothing else in the library imports this subpackage.
"""
