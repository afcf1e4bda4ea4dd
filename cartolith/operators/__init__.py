"""The tools, one module for each family."""

from .check import check_geometry, recalculate_feature_class_extent, repair_geometry
from .extract import clip, copy, copy_features, copy_rows, delete_features, delete_rows, extract_features, extract_rows, get_count, select, split, split_by_attributes, table_select, truncate_table
from .features import (
    add_xy_coordinates, calculate_geometry_attributes, explode, feature_envelope_to_polygon, feature_to_point, feature_vertices_to_points, minimum_bounding_geometry,
    multipart_to_singlepart, polygon_to_line, split_line_at_vertices, xy_table_to_line, xy_table_to_point, xy_to_line,
)
from .fields import add_field, add_gps_metadata_fields, alter_field, calculate_end_time, calculate_field, delete_field
from .general import delete_identical, find_identical
from .generalization import dissolve
from .indexes import add_attribute_index, add_spatial_index, remove_attribute_index, remove_spatial_index
from .overlay import erase, intersect, symmetrical_difference, union
from .projections import define_projection, project
from .proximity import buffer, create_thiessen_polygons, multiple_buffer
from .workspace import create_feature_class, create_folder, create_geopackage, create_sqlite_database, create_table, delete, feature_class_to_geopackage, rename, table_to_geopackage

__all__ = [n for n in dir() if not n.startswith("_")]
