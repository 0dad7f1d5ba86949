"""Boolean text search and corpus analytics over crawled pages, as Spark plans."""
