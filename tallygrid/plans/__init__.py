"""Whole-table profiles and the report tables derived from them."""
