"""Entry points, and the queries over the driver tables."""
