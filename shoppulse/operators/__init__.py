"""DataFrame -> DataFrame operators, grouped by chain."""
