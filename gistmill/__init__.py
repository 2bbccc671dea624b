"""gistmill: a Spark-first engine over conversations, documents and the graph drawn from them."""
