"""windrow: window similarity, factor analytics and corpus preparation on PySpark."""
