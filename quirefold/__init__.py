"""quirefold: a Spark-native engine for bibliographic record linkage."""
