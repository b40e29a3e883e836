"""Bar readers, bar builders and the result store."""
