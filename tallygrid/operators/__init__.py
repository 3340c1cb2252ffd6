"""Profiling operators over a :class:`tallygrid.grid.Grid`."""
