"""Column expressions: word lists, text, clocks, evidence, titles."""
