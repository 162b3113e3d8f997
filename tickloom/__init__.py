"""tickloom: market analytics as composable PySpark DataFrame functions."""
