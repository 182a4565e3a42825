"""gleanframe: harvest releases, links and clean text from stored pages, as Spark jobs."""
