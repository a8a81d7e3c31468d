"""Knowledge graphs and retrieval over tables of documents, as Spark plans."""
