"""Code-search analytics on Spark: a search language, a content-addressed index, and its upkeep."""
