"""Operators for large text corpora. Nothing else in voxloom imports this subpackage."""
