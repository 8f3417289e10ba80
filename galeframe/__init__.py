"""Forecast-grid, passage and text-corpus analytics as Spark DataFrame programs."""
