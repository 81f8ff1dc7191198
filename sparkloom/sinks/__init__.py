"""Tables that batches are merged into by key."""
