"""Spark-native source-code risk analytics and corpus preparation."""
