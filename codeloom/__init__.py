"""codeloom: analytics over property graphs of software, expressed as Spark DataFrame jobs."""
