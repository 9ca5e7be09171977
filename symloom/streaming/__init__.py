"""Change feeds and incremental maintenance."""
