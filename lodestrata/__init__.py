"""lodestrata: repository-evidence analytics as Spark DataFrame plans."""
