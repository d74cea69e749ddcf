"""Query plans over the sequence tables, and their registry."""
