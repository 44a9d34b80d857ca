"""Table-to-table operators of the model (lazy DataFrame functions)."""
