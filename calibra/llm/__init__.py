"""Training-data operators: near-duplicates, PII, tokenization, classifiers, search and mixing.

Nothing else in the library imports this subpackage; removing it leaves the rest working.
"""
