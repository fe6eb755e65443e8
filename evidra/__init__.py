"""evidra: document-evidence analytics expressed as Spark DataFrame plans."""
