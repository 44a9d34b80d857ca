"""Jobs: the fixture context, the main model, and the query registry."""
