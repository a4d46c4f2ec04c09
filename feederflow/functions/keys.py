"""Keys that tables of loads share."""

from pyspark.sql import DataFrame


def shared_keys(*tables: DataFrame) -> list[str]:
    """``n`` and ``load_id`` where all tables have the network, else ``load_id``, which must then be unique over networks."""
    return ["n", "load_id"] if all("n" in t.columns for t in tables) else ["load_id"]
