"""Sources: Turtle, GeoJSON, driver tables as triples, and the parquet store."""
