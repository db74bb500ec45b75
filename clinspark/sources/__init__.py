"""Table readers, the extract bundle and the read-through cache."""
