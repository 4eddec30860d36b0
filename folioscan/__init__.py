"""Analytics over wiki XML dumps, written as Spark DataFrame plans."""
