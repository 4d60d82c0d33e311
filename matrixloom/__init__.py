"""Score-matrix analytics on Spark: cells, surfaces, pair geometry, ranking and resampling."""
