"""Training-data operators: license scans, WARC, chat formatting, packing,
language models and identification, near and exact duplicates, tokenising
and exact search.  Nothing else in the library imports this subpackage;
its queries are listed in ``queries.py``."""
