"""Documentation-governance analytics as Spark DataFrame plans."""
