"""Vector geoprocessing over Spark DataFrames.

``from cartolith import tools`` style access to everything public::

    from cartolith.model import FeatureFrame, FeatureMeta
    from cartolith.operators import extract, overlay, proximity, features
"""
