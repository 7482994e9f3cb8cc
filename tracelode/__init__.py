"""tracelode: corpus, retrieval and trace analytics as PySpark jobs."""
