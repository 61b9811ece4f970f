"""Seismic catalogue, intensity and impact analytics as Spark DataFrame operators."""
