"""Analytics on labelled conversations and other ordered, categorised event data, on Spark."""
