"""Inputs derived from the driver tables."""
