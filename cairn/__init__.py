"""cairn: knowledge-base analytics expressed as Spark plans."""
