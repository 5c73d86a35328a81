"""Tables: flat files in sharded form, and partitioned storage."""
