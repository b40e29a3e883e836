"""Column expressions and distributed order-dependent building blocks."""
