"""Column expressions: numerics, buckets, hashes, classifications."""
