"""Weftline: composable data and document pipelines as Spark DataFrame plans."""
