"""Column expressions: no UDF, so they stay inside whole-stage code generation."""
