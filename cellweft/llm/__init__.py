"""Training-data operators for very large text corpora.

Self-contained: nothing outside this subpackage imports it, and it imports nothing of the rest of the library.
"""
