"""Raster, region, contour and document analytics as composable Spark DataFrame operators."""
