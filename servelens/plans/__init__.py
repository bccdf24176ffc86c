"""Input projections, the composite adjudication plan and the query registry."""
