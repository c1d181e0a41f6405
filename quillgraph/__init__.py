"""Graph queries, linking, evaluation and data preparation as Spark plans."""
