"""Query catalogues: a Spark plan and, where SQL can express it, an oracle for each."""
