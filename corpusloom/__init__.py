"""corpusloom: retrieval analytics over document corpora, as Spark plans."""
