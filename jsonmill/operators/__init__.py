"""Column and DataFrame operators on JSON text."""
