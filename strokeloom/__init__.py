"""Raster reveal-order analytics, expressed as Spark DataFrame operators."""
