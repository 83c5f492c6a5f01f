"""Analytics over rating-stratified reviews, as Spark DataFrame operators."""
