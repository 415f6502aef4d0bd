"""A vector search engine on Spark: collections of points, exact and approximate top-k, filters, durable changes."""
