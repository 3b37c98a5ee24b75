"""tidemill: document retrieval, agent evaluation and corpus preparation as Spark plans."""
