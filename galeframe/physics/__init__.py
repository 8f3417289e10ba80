"""Force balance of a sailing boat: one set of formulas for Spark columns and for numpy arrays, and a batch solver."""
