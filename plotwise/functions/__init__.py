"""Column expressions: pure, row-local, JVM-side wherever Spark can express them."""
