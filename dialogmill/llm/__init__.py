"""Operators for preparing training corpora at scale, and their queries."""
