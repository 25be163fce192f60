"""Column functions: text, dates, markup, posts, tokens."""
