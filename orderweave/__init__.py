"""Purchase-order analytics as composable PySpark DataFrame functions."""
