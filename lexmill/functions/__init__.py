"""functions of the retrieval and corpus engine."""
