"""Table operators: links, routing, de-dup and state, crawl, documents, statistics, ranking."""
