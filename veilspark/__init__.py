"""Finding, masking and restoring personal data in tables, the Spark way."""
