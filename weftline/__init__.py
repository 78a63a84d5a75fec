"""weftline: corpus curation and typed-decision analytics as PySpark DataFrame pipelines."""
