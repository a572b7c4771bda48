"""Race-result analytics expressed as Spark DataFrame plans."""
