"""Seismic catalogue analytics expressed as Spark DataFrame plans."""
