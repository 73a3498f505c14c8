"""Readers of provider files and pages, and writers of the engine's tables."""
