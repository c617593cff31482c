"""linkloom.plans."""
