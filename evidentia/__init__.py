"""A PySpark engine for multimodal evidence processing over many cases at once."""
