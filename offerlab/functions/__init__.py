"""Column-level helpers (vector math, hashing, text)."""
