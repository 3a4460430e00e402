"""Column expressions over terms and numbers."""
