"""Training-data operators: language, quality, duplicates, leaks, tokens, shards, pages and licences."""
