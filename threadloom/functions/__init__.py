"""Column expressions shared by operators; all of them stay in the JVM."""
