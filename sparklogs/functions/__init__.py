"""Column functions: timestamps and buckets, attribute values, patterns."""
