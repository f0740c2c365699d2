"""Text-prediction analytics on Spark: corpora, language models, taggers and predictors as DataFrame plans."""
