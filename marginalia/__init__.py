"""Search over collections of markdown notes, expressed as Spark plans."""
