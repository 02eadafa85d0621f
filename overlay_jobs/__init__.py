"""Spark jobs that turn overlapping treatment polygons into one layer of atomic zones with event histories."""
