"""Reading nested documents, and writing results."""
