"""Column functions: keyed hashes, draws, checksums, dates, Feistel encryption and synthetic values."""
