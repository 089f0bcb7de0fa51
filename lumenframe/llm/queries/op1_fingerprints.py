"""Every document's fingerprint, that of its edited text, and how alike they and the next document's are."""

from lumenframe.llm import parsing
from lumenframe.llm.common import table

ORACLE_SQL = None


def query(spark, sf_dir):
    return parsing.edited_fingerprints(table(spark, sf_dir, "documents"))
