"""linkloom.operators."""
