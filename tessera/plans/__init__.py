"""End-to-end studies and the registry of named queries."""
