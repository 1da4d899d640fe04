"""Column expressions.  Everything here stays on the JVM; there is no Python UDF."""
