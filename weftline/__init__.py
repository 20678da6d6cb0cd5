"""weftline: dialogue curation and session analytics expressed as Spark DataFrame plans."""
