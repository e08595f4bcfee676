"""lakewright: composable, lazily evaluated data-processing operators for PySpark."""
