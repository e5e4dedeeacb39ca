"""Multi-operator jobs composed from the operators."""
