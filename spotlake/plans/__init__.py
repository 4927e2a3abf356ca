"""Rules and settings: configuration, patterns, and the predicate they compile to."""
