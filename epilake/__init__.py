"""epilake: Spark surveillance analytics (see README.md)."""
