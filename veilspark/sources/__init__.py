"""Where requests come from and mappings go."""
