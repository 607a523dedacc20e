"""Permission-aware hypergraph analytics expressed as PySpark DataFrame operators."""
