"""tessera: a versioned multi-model analytics engine expressed as Spark DataFrame plans."""
