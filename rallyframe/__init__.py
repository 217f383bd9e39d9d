"""rallyframe: Spark-first cleaning, deduplication and reporting of match-result feeds."""
