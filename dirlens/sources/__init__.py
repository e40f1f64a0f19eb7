"""Readers, writers and derived test documents."""
