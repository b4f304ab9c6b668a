"""Spark-native preparation and evaluation of instruction, chat and text corpora."""
