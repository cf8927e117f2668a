"""clauseloom: Spark jobs that check rewritten legal text against its source."""
