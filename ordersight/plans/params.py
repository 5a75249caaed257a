"""Fixed parameters of the registered queries (the "current" and "previous"
reporting periods of the test data, filter ids, top-k sizes)."""

CURRENT = ("1996-08-01", "1996-08-31")
PREVIOUS = ("1996-07-01", "1996-07-31")
YEAR = ("1996-01-01", "1996-12-31")
FILTER_WAREHOUSE = 5
FILTER_CUSTOMER = 7
FILTER_VENDOR = 4
TOP_K = 3
MIN_SIMILARITY = 0.2
QUERY_VECTOR_EVERY = 50        # embeddings with vec_id % 50 = 0 are the search queries; all rows are the index
CHUNK_MAX_CHARACTERS = 1800
EMBED_DIM = 64
