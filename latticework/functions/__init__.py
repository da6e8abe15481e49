"""Column expressions and DataFrame primitives for vectors and matrices."""
