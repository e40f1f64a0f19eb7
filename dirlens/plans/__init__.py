"""Feature tables and the named reports."""
