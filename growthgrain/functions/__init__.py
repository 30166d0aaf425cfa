"""Column expressions and aggregate expressions; all run on the JVM side."""
