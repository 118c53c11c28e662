"""Column expressions, fixed values and the skew-safe building blocks every operator uses."""
