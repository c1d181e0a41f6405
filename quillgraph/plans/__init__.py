"""Cypher text to DataFrame plans: lexer, parser, graph catalog, compiler, session."""
