"""op4: archive every page, read the archives back."""

from fieldloom.llm.registry import query
from fieldloom.llm.warc import archive_folder, read_archives, write_archives

SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN top <> page_id THEN top END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""


@query("op4_warc", SQL)
def op4(t):
    index = write_archives(t.pages, archive_folder(t.pages))
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
