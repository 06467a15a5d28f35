"""Assignment, pricing, placement and exact solvers over DataFrames of points and sites."""
