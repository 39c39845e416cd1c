"""Folds of documents, and the tables that a job keeps in the folder all machines share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode.plans.storage import shared_folder, written

__all__ = ["fold", "shared_folder", "written"]


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts
