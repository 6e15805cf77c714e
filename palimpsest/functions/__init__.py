"""Column expressions and the functions behind the engine's UDFs."""
