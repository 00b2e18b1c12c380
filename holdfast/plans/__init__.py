"""Query catalogue: Spark query and SQL oracle for every operator."""
