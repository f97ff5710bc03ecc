"""SQL with named parameters over a set of tables, and several tables' changes as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heronlake.sources.tables import TableStore


class Gateway:
    """Queries name tables in braces (``{torrents}``) and parameters with a colon (``:state``); a parameter of None is NULL."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | TableStore):
        self.spark, self.tables = spark, tables

    def _used(self, sql: str) -> dict[str, DataFrame]:
        if isinstance(self.tables, TableStore):
            return {t: self.tables.read(t) for t in self.tables.schemas if "{" + t + "}" in sql}
        return {t: df for t, df in self.tables.items() if "{" + t + "}" in sql}

    def query(self, sql: str, **parameters) -> DataFrame:
        return self.spark.sql(sql, args=parameters, **self._used(sql))

    def execute(self, changes: dict[str, str], **parameters) -> dict[str, int]:
        """Each table's next rows by a query, all read before any is written; the new versions."""
        if not isinstance(self.tables, TableStore):
            raise TypeError("only a table store can be written")
        return self.tables.commit({table: self.query(sql, **parameters) for table, sql in changes.items()})
