"""DataFrame operators: recency, similarity, selection, store, search, metrics, digest."""
