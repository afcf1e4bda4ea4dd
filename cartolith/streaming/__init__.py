"""Layers that are streams.

Row-local tools (selections, conversions, envelopes, vertices, projections, buffers of points) take a layer over a
streaming DataFrame as they are. Joining a stream with a static layer is row-local too, as long as that layer is small enough
to be broadcast, which is checked here; grouping tools need all rows and aren't for streams.
"""

from .static import clip_points, intersect, write

__all__ = ["clip_points", "intersect", "write"]
