"""chronoscope: forensic timelines and detection rules as Spark DataFrames."""
