"""Column-level functions; each one stays inside JVM expressions."""
