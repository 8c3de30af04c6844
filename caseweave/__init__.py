"""Support-case analytics as composable PySpark DataFrame operators."""
