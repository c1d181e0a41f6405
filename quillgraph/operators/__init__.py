"""Relational operators of the question-answering pipeline, on DataFrames."""
