"""LaTeX text from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for each of LaTeX's special characters.
LATEX = (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("^", "\\^{}"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"))


def latex_escaped(text: Column) -> Column:
    """Each special character on its own, so that what one stands for isn't escaped again; null is empty."""
    known = F.create_map(*(F.lit(x) for pair in LATEX for x in pair))
    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), ""), lambda c: F.coalesce(F.element_at(known, c), c)), "")


def latex_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    known = ", ".join(f"'{a}': '{b}'" for a, b in LATEX)
    return f"coalesce(array_to_string([coalesce(map {{{known}}}[c], c) FOR c IN string_split({text}, '')], ''), '')"
