"""Table schemas.  Tables are read with these, never inferred."""

from pyspark.sql import types as T

_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "headers": T.MapType(T.StringType(), T.StringType()),
}


def _schema(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields.items()])


PAGES = _schema(page_id="bigint", url="string", html="string")
PAGES_WITH_META = _schema(
    page_id="bigint", url="string", html="string", content_type="string", status_code="int", headers="headers"
)
ROBOTS = _schema(host="string", status_code="int", body="string")
SITEMAPS = _schema(sitemap_url="string", body="string")
RESOURCES = _schema(url="string", content_type="string", content="string")
URL_STATE = _schema(url="string", status="string", last_fetched="timestamp", level="int", outcome="string")
RESOURCE_MAP = _schema(url="string", local_path="string")
SEEN_SITEMAPS = _schema(url="string")
LINKS = _schema(page_id="bigint", src_url="string", kind="string", raw="string", dst_url="string")
