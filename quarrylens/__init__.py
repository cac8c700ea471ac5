"""Analytics for evolving collections of texts, events and graphs, written as Spark DataFrame operators."""
