"""Scalar functions as column expressions, and the few text scans that need Python."""
