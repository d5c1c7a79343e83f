"""taktwerk: production-flow analytics as Spark DataFrame plans."""
