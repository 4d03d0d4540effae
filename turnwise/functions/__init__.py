"""Column expressions. All are JVM-side built-ins; none is a Python UDF."""
