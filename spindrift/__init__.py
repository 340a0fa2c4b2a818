"""Document search, text analysis and feedback analytics on the DataFrame API."""
