"""quire: document-format compliance over whole corpora, as Spark DataFrames."""
