"""Raster tables: pixel areas, reclassification, zonal statistics, tile indices."""
