"""cellweave: raster, zonal and point analytics as Spark DataFrame operators."""
