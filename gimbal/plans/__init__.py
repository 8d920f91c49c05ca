"""Queries of the engine; importing the package registers all of them."""

from . import camera_queries, catalog, file_queries, geometry_queries, image_queries, log_queries, sampling_queries, source_queries, text_queries

__all__ = ["camera_queries", "catalog", "file_queries", "geometry_queries", "image_queries", "log_queries", "sampling_queries", "source_queries", "text_queries"]
