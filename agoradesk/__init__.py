"""Document-assistant analytics expressed as Spark DataFrame operators."""
