"""Nothing is streamed yet: every source is a batch of files."""
