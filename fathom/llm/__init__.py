"""Operators that prepare text for training language models, their queries and oracle SQL."""
