"""Where data comes from and goes to: files, the raw store, source trees, the registry, run records."""
