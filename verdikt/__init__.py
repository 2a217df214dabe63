"""Spark jobs for model-evaluation data: DataFrame in, DataFrame out."""
