"""Urban-activity analytics on Spark: operators, sources, plans and streams."""
