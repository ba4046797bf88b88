"""Relational operators: path trees, postings and their planner, usage, catalogue dedup and statistics."""
