"""Scans: feeds, rasters and boundaries."""
