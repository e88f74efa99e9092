"""threadloom: project-history retrieval and corpus preparation as Spark jobs."""
