"""lakeloom: knowledge retrieval, text analytics and corpus preparation as Spark plans."""
