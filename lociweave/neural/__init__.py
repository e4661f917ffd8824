"""Neural networks on NumPy: differentiation, layers, training, and their use in Spark."""
