"""Column functions: geometry, sun position, scores, time, display."""
