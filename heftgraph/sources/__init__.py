"""Readers of build artefacts."""
