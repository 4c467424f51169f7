"""Views of the driver's tables in the memory model, and the query registry."""
