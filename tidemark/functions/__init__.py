"""Column expressions. All of them compile to JVM expressions; none calls Python per row."""
