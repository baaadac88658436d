"""Log forensics on Spark: records, failure phrases, keyword spans and reports as DataFrames."""
