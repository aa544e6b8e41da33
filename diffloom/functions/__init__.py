"""Column functions: every one takes and returns Spark columns and stays inside the JVM."""
