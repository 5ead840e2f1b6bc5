"""Training-data operators over documents, pages, labels and embeddings.

Nothing outside this subpackage imports it.  ``queries`` registers one query per operator.
"""
