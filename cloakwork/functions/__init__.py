"""Column expressions: text, validators, context tests, replacements, array helpers."""
