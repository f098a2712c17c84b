"""termloom: a search-analytics engine written as Spark DataFrame plans."""
