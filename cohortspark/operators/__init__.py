"""Views and analytic operators, each a function of DataFrames."""
