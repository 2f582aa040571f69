"""Process analytics expressed as Spark DataFrame plans."""
