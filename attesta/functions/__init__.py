"""Column -> Column functions; everything here stays inside JVM codegen unless it says otherwise."""
