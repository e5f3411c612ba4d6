"""Forum-text corpus analytics as ordinary Spark jobs."""
