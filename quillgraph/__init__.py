"""quillgraph: a text-memory and retrieval engine made of Spark DataFrame operators."""
