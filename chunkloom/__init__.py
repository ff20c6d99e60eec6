"""Spark-native data reduction: chunk, fingerprint, resemble, choose bases, pack, restore, report."""
