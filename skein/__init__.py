"""skein: rolling-window forecast evaluation and corpus processing on Spark."""
