"""Row transforms, aggregates, keys and star-schema operators, each a function of DataFrames."""
