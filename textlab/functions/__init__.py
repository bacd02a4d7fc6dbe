"""Column expressions: text cleaning, label alignment, vectors, seeded hashing."""
