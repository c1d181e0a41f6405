"""Readers and writers: seed scripts, benchmarks, JSON lines, completions, reports."""
