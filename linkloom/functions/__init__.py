"""linkloom.functions."""
