"""Row-local operators on streams: what needs no statistics of the whole table."""
