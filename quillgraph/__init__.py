"""quillgraph: property-graph analytics on PySpark."""
