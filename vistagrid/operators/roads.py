"""Road segment operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_identity(roads: DataFrame) -> DataFrame:
    """Direction-free identity of a segment: way id and the smaller digest of its points snapped to 1e-7 degrees."""
    grid = F.transform("geom", lambda p: F.concat_ws(
        ",", F.round(p["lon"] * 1e7).cast("bigint").cast("string"), F.round(p["lat"] * 1e7).cast("bigint").cast("string")))
    forward, backward = F.md5(F.array_join(grid, ";")), F.md5(F.array_join(F.reverse(grid), ";"))
    return roads.withColumns({
        "identity_key": F.concat_ws(":", F.col("way_id").cast("string"), F.least(forward, backward)),
        "canonical_forward": forward <= backward,
    })
