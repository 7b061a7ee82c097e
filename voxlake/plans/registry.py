"""All queries of the volume engine, gathered from their modules."""

from . import access_queries, codec_queries, file_queries, image_queries, render_queries, sample_queries, segment_queries, serving_queries, store_queries, trace_queries, volume_queries, zarr_queries  # noqa: F401
from .register import QUERIES, SQL  # noqa: F401
