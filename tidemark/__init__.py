"""Card-transaction feature analytics as Spark DataFrame operators."""
