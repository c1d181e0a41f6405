"""Corpus operators for training-data pipelines (text, vectors, pages, chats)."""
