from relevia.sources.tables import materialize, most_frequent, remove_tables, table

__all__ = ["materialize", "most_frequent", "remove_tables", "table"]
