"""Column functions: no joins, no shuffles, no Python per row unless said."""
