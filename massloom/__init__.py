"""Spark-first operators for tandem mass-spectrometry analytics and corpus preparation."""
