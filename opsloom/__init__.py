"""Operations analytics on Spark: retrieval, intake scoring, catalog sync,
tenancy, KPIs, usage cost, inbox text, data quality and event streams.

Every public function takes and returns DataFrames or Columns; nothing in the
library collects table rows to the driver.
"""

from opsloom.session import build_session, load_tables, prepare_session

__all__ = ["build_session", "load_tables", "prepare_session"]
