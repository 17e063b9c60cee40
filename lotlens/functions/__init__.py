"""Column expressions. Everything here runs inside the JVM; no Python per row."""
