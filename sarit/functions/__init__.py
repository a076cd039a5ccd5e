"""Part of sarit."""
