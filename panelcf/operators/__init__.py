"""Building blocks: DataFrame in, DataFrame out, nothing is run eagerly."""
