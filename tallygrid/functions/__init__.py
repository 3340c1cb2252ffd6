"""Column expressions: cell text, parsing and display formats."""
