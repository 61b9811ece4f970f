"""Catalogue, statistics, intensity, band and impact operators."""
