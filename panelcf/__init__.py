"""panelcf: policy evaluation on large panels of daily series, as Spark jobs.

Sub-packages
------------
functions   column expressions (dates, periods, encodings, map projection)
sources     readers, writers and the incremental upsert
operators   DataFrame -> DataFrame building blocks
plans       multi-step jobs (zone tables, imputed panel, full evaluation)
registry    queries over the sample tables, each next to its check SQL
"""

from panelcf.functions.columns import HOUSE, PanelCols

__all__ = ["HOUSE", "PanelCols"]
