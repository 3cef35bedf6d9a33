"""cinegrain: a PySpark-native analytics engine for media-library data.

Catalogue tables, event logs and vector tables go in as DataFrames; rankings,
time patterns, hierarchies, profiles, similarity, coverage, recommendations and
dataset preparation come out as DataFrames.
"""

__version__ = "0.1.0"
