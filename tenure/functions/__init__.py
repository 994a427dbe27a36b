"""Column functions shared by the plans; all run inside the JVM."""
