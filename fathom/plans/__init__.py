"""Whole jobs and the catalogue of registered queries with their oracles."""
