"""Building blocks: DataFrame in, DataFrame out, column names as parameters."""
