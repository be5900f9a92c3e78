"""Training-data operators: thirteen dealt operators, their queries and SQL, as one removable subpackage."""
