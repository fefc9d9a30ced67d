"""Summary-method phylogenetics as Spark jobs."""
