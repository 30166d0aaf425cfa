"""Plain SQL against which the Spark queries are checked."""
