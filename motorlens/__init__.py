"""Used-vehicle market analytics expressed as Spark DataFrame plans."""
