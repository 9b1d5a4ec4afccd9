"""Social-account analytics as DataFrame-to-DataFrame functions on Spark."""
