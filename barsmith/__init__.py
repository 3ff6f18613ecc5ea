"""Spark-native market bars: candles, their queries, retention, streaming and audit."""
