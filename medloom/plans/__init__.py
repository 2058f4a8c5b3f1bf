"""The guarded SQL surface, the query service and the batch pipeline."""
