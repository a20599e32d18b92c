"""Kept empty on purpose: the work covered here has no stream source, window or state (see README)."""
