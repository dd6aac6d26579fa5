"""askloom: document retrieval and grounded question answering as Spark jobs."""
