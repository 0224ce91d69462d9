from quarterloom.sources.tables import table

__all__ = ["table"]
