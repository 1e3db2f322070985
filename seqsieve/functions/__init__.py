"""Column builders: signals of a draw, formulas over series, scoring functions."""
