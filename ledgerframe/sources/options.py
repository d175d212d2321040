"""The options file: `key = value` lines with # comments."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Option to its default; the default's type is the option's.
DEFAULTS: dict[str, object] = {"applyIntervalMs": 3000, "fetchBatchRows": 1000, "catalogFile": "dataSets.xml", "buddyServers": []}


def read_options(spark: SparkSession, path: str | None = None) -> dict[str, object]:
    """Defaults with what the file sets; names in any case, comma lists for
    list options, unknown names kept as text."""
    out = dict(DEFAULTS)
    names = {n.lower(): n for n in DEFAULTS}
    lines = [r[0] for r in spark.read.text(path).collect()] if path else []  # a hand-written file
    for line in lines:
        name, sign, value = line.split("#", 1)[0].partition("=")
        if not sign:
            continue
        name, value = names.get(name.strip().lower(), name.strip()), value.strip()
        default = DEFAULTS.get(name)
        if isinstance(default, int):
            out[name] = int(value)
        else:
            out[name] = [v.strip() for v in value.split(",") if v.strip()] if isinstance(default, list) else value
    return out
