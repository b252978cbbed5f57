"""The stateless manuscript checks on a stream of lines: each line is judged alone, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame

from folioguard.operators import manuscript as M


def line_findings(lines: DataFrame) -> DataFrame:
    """Findings of a (streaming or static) DataFrame of doc_id, line_no, line."""
    return M.placeholders(lines).unionByName(M.headings(lines)).unionByName(M.phrase_tells(lines))
