"""Spark jobs for dialog analytics: from interaction logs to dialogs, features, clusters and profiles."""
