"""linkloom.sources."""
