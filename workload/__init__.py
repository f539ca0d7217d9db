"""Queries over the given tables: every document stands for one media file."""
