"""skeinwork: a PySpark-native engine for web-crawl data and usage analytics."""
