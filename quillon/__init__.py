"""Quillon: automated tabular analytics and corpus preparation, expressed as Spark plans."""
