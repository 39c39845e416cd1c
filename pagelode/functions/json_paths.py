"""Values out of JSON text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path_or_default(text: Column, path: str, default: str | None = None) -> Column:
    """the value at a dotted path of objects as text.

    A path that does not exist gives the default; a value that is there but null stays null.
    """
    *parents, last = path.split(".")
    steps = "".join(f'["{key}"]' for key in parents)
    doc = F.try_parse_json(text)
    parent = F.try_variant_get(doc, f"${steps}", "map<string,variant>")
    value = F.try_variant_get(doc, f'${steps}["{last}"]', "string")
    return F.when(F.coalesce(F.map_contains_key(parent, F.lit(last)), F.lit(False)), value).otherwise(
        F.lit(default))
