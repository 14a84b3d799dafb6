"""Readers, writers, shared scratch tables and the derived loan tables."""
