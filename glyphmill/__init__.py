"""glyphmill: corpus and vocabulary analytics expressed as Spark plans."""
