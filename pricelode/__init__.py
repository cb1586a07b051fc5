"""Drug-pricing analytics as Spark DataFrame operators."""
