"""Column functions: pure Catalyst expressions over strings, URLs, HTML and vectors."""
