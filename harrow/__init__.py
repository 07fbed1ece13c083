"""harrow: a full-text search corpus (crawl intake, index, ranking) as Spark jobs."""
