"""Column functions built only from Spark SQL expressions."""
