"""Point-in-time analytics on entity-by-period tables, as plain Spark DataFrame plans."""
