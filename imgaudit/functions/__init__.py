"""Column functions: keys, seeds, conditions and feature arrays."""
