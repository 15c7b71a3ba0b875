"""Training-data operators over documents, pages, embeddings and conversations.

Nothing outside this subpackage imports it; its queries are registered by ``queries.py``.
"""
