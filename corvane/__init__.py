"""corvane: repository context, call metrics and session analytics as Spark plans."""
