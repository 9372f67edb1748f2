"""Lodestone: document analytics and retrieval evaluation as Spark plans."""
