"""keyloom: keyed document tables, their change feeds and their derived data, as Spark plans."""
