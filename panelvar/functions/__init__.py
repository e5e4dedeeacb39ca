"""Column expressions: window frames, guarded math, hashing, distribution tails."""
