"""Document-threat analytics and text preparation as PySpark plans."""
