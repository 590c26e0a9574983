"""Point-cloud quantization analytics expressed as Spark DataFrame operators."""
