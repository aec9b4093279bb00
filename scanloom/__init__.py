"""Dataset-curation and evaluation analytics expressed as PySpark DataFrame plans."""
