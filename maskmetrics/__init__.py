"""Measures of how well texts were anonymised, as Spark queries over whole corpora."""
