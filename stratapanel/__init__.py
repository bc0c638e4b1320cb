"""Daily stock-panel analytics expressed as Spark DataFrame plans."""
