"""Siltstone: a versioned key-value analytics engine expressed as Spark plans."""
