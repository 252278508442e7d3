"""tabspark: tabular analysis on Spark -- prepare, profile, explore, test, model, version."""

__all__ = ["schema", "session"]
