"""symweave: code-graph analytics and data-pipeline operators as PySpark DataFrame programs."""
