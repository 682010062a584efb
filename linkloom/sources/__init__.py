"""Tables, queues and snapshots."""
