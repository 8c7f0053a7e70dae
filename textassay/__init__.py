"""Text-verification analytics as composable PySpark DataFrame transformations."""
