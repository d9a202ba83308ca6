"""How well chunks compress, measured on few of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def cell_ratios(pixels: DataFrame, dtype: str = "<u2", level: int = 5) -> DataFrame:
    """t, raw, packed (bytes) and ratio of zstd over the given pixels of each step, all of one cell."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        raw = rows.sort_values(["b", "y", "x"])["v"].to_numpy().astype(dtype).tobytes()
        n = len(zstandard.ZstdCompressor(level=level).compress(raw))
        return pd.DataFrame({"t": [rows["t"].iloc[0]], "raw": [len(raw)], "packed": [n], "ratio": [n / len(raw)]})

    return pixels.select("t", "b", "y", "x", "v").groupBy("t").applyInPandas(pack, "t int, raw long, packed long, ratio double")
