"""Readers that turn files and queries into grids."""
