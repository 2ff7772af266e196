"""Column -> Column building blocks (checksums, masks, ciphers, text helpers)."""
