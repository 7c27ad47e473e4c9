"""tidewater: message-archive analytics on Spark DataFrames."""
