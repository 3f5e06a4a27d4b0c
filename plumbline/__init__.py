"""A PySpark analytics engine for points, meshes, polylines, rasters and series held as DataFrames."""
