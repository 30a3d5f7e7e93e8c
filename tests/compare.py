"""Rows of a Spark and a DuckDB result in one canonical form."""

import math


def canon(pdf):
    pdf = pdf[sorted(pdf.columns)]

    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
            return "~"
        if isinstance(x, float) or "float" in type(x).__name__:
            return f"{float(x):.8g}"
        if "bool" in type(x).__name__:
            return str(bool(x))
        return str(x)

    return sorted(tuple(cell(x) for x in r) for r in pdf.itertuples(index=False))
