"""PySpark engine for catalogs of files: state, projection, ranked search."""
