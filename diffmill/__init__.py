"""diffmill: review analytics and training-data operators as Spark DataFrame plans."""
