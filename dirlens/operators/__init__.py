"""DataFrame operators over feature tables."""
