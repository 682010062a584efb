"""Explicit schemas of the tables the library reads and writes."""

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_LONG, _INT, _STRING = T.LongType(), T.IntegerType(), T.StringType()

PAGES = _table(page_id=_LONG, url=_STRING, html=_STRING)
LINK_TEXT = _table(seq=_LONG, link=_STRING, text=_STRING)
FRONTIER = _table(seq=_LONG, url=_STRING, depth=_INT)
SEEN_LINKS = _table(seq=_LONG, pos=_INT, url=_STRING)
QUEUE = _table(seq=_LONG, value=_STRING)

LINK_TAGS = _table(seq=_LONG, link=_STRING, rank=_INT, tag=_STRING)
CORPUS_STATS = _table(doc_count=_LONG)
TERM_STATS = _table(term=_STRING, cf=_LONG)
TAG_INDEX = _table(tag=_STRING, link=_STRING, popularity=_LONG)

LINKS = _table(id=_LONG, link=_STRING)
TAGS = _table(id=_LONG, tag=_STRING)
JUNCTION = _table(link_id=_LONG, tag_id=_LONG)
