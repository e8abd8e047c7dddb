"""Functions as column builders, text analysis, and the query mini-language."""
