"""A PySpark engine that builds and queries question-answering knowledge bases."""
