"""Product tables out of archived web pages, as Spark jobs."""
