"""tidemill: batch, window, streaming and text analytics written as plain Spark jobs."""
