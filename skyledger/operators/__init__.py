"""Row and table operators: cleaning, deduplication, validation, merging."""
