"""Settings, the registered queries and their SQL twins."""
