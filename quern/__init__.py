"""quern: Spark DataFrame operators for document, retrieval and log analytics."""
