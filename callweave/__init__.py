"""Conversation analytics as Spark jobs: corpora, clusters, call graphs, retrieval, evaluation."""
