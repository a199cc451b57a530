"""Urban raster, point-cloud and zonal analytics expressed as Spark DataFrames."""
