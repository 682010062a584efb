"""SQL that states each registered query over the same tables."""

from __future__ import annotations

from linkloom.functions.text import PUNCTUATION, STOP_WORDS
from linkloom.plans import queries as q

_SPACE = r"[\x{1c}-\x{1f}\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + word.replace("'", "''") + "'" for word in words)


_DROPPED = _quoted(STOP_WORDS + PUNCTUATION)
_SPLIT = f"list_filter(regexp_split_to_array(lower(text), '{_SPACE}'), lambda w: w <> '')"
_KEPT = f"list_filter({_SPLIT}, lambda w: w NOT IN ({_DROPPED}))"

_DOCS = "docs AS (SELECT doc_id AS seq, source AS link, text FROM documents)"


def _shown(html: str) -> str:
    """Text nodes of HTML, decoded, trimmed and joined."""
    bare = rf"regexp_replace({html}, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '<br>', 'g')"
    node = "node"
    for name, value in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        # These names also count without the semicolon, as where a title was cut.
        node = f"regexp_replace({node}, '&{name};?', '{value}', 'g')"
    nodes = f"list_transform(regexp_split_to_array({bare}, '<[^>]*>'), lambda node: trim({node}, e' \\t\\n\\r'))"
    return f"array_to_string(list_filter({nodes}, lambda node: node <> ''), ' ')"


_BODY = "regexp_extract(html, '(?s)<body[^>]*>(.*)', 1)"
_PAGE_DOCS = f"docs AS (SELECT page_id AS seq, url AS link, {_shown('html')} AS text FROM pages)"
_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"

_LINKS = rf"""
hrefs AS (
  SELECT page_id, url AS src, {_ORIGIN} AS origin,
         regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>', '', 'g'),
                            '<a href="([^"]*)"', 1) AS found
  FROM pages),
page_link AS (
  SELECT page_id, src, origin, unnest(found) AS href, generate_subscripts(found, 1) - 1 AS pos FROM hrefs),
link AS (SELECT page_id AS seq, pos::INT AS pos, src, replace(origin || href, '&amp;', '&') AS url FROM page_link)"""
_FIRSTS = "firsts AS (SELECT url, min(seq * 1000000 + pos) AS place FROM link GROUP BY url)"
_FIRST_COLUMNS = "url, place // 1000000 AS seq, (place % 1000000)::INT AS pos"
_STORED = "stored AS (SELECT DISTINCT url FROM link WHERE src LIKE 'http://%')"

# words -> term counts -> numbers as of each document -> scores; reads docs(seq, link, text)
_TERMS = f"""
words AS (SELECT seq, {_KEPT} AS kept FROM docs WHERE text <> ''),
word AS (SELECT seq, len(kept) AS len, unnest(kept) AS term, generate_subscripts(kept, 1) AS pos FROM words),
tf AS (SELECT seq, len, term, count(*) AS tf, min(pos) AS pos FROM word GROUP BY ALL),
number AS (SELECT seq, row_number() OVER (ORDER BY seq) AS n FROM words)"""
_ARRIVAL = f"""{_TERMS},
counts AS (
  SELECT tf.*, n, sum(tf) OVER (PARTITION BY term ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS cf
  FROM tf JOIN number USING (seq)),
scores AS (SELECT *, tf / len * (ln((1 + n) / (1 + cf)) + 1) AS score FROM counts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, pos)::INT AS rank FROM scores),
tagged AS (SELECT seq, link, rank, term AS tag FROM ranked JOIN docs USING (seq) WHERE rank <= 5)"""

_DOC_TAGS = f"WITH {_DOCS}, {_ARRIVAL}"
_PAGE_TAGS = f"WITH {_PAGE_DOCS}, {_ARRIVAL}"

# links, tags and junction over tagged(seq, link, rank, tag)
_STAR = f"""{_PAGE_TAGS},
links AS (SELECT row_number() OVER (ORDER BY min(seq)) AS id, link FROM tagged GROUP BY link),
tags AS (SELECT row_number() OVER (ORDER BY min(seq * 10 + rank)) AS id, tag FROM tagged GROUP BY tag),
junction AS (
  SELECT DISTINCT links.id AS link_id, tags.id AS tag_id FROM tagged JOIN links USING (link) JOIN tags USING (tag))"""

_STAR_ROWS = """
SELECT 'links' AS part, id, link AS value FROM links
UNION ALL SELECT 'tags', id, tag FROM tags
UNION ALL SELECT 'junction', link_id, tag_id::VARCHAR FROM junction"""

_DOCUMENT_LINKS = """
rows AS (
  SELECT doc_id AS seq, 'http://' || source || '.example/' || lang || '/' || n_chars AS url, sha256(text) AS text_hash
  FROM documents)"""

_MESSAGES = "numbered AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS seq, * FROM conversations)"
# Before each opening turn its bare text is queued, which cannot be decoded.
_READABLE = f"{_MESSAGES}, readable AS (SELECT * REPLACE (seq * 2 AS seq) FROM numbered)"

_BASE = "http://shop.example"

ORACLES = {
    "page_source": "SELECT page_id, url, html FROM pages",
    "pages_surveyed": "SELECT count(*) AS pages FROM pages",
    "fetched_pages": "SELECT page_id, 200 AS status FROM pages WHERE page_id % 4 <> 3",
    "readable_pages": f"""WITH {_LINKS}, {_PAGE_DOCS}
        SELECT seq, NULL::INT AS pos, text AS value FROM docs WHERE seq % 5 <> 0 AND text <> ''
        UNION ALL SELECT seq, pos, url FROM link WHERE seq % 5 <> 0""",
    "page_text": f"SELECT page_id, {_shown('html')} AS text FROM pages",
    "page_body_text": f"SELECT page_id, {_shown(_BODY)} AS text FROM pages",
    "link_text": f"WITH {_PAGE_DOCS} SELECT seq, link, text FROM docs",
    "nonempty_pages": f"SELECT page_id AS seq, url AS link FROM pages WHERE {_shown(_BODY)} <> ''",
    "page_origin": f"SELECT page_id, {_ORIGIN} AS origin FROM pages",
    "page_links": f"WITH {_LINKS} SELECT page_id, pos::INT AS pos, replace(href, '&amp;', '&') AS href FROM page_link",
    "resolve_links": f"WITH {_LINKS} SELECT seq AS page_id, pos, url FROM link",
    "resolve_links_page": rf"""WITH {_LINKS}
        SELECT page_id, pos::INT AS pos,
               CASE WHEN href = '/' THEN regexp_replace(src, '#.*', '')
                    ELSE regexp_extract(src || CASE WHEN src SIMILAR TO '[a-z]+://[^/?#]*' THEN '/' ELSE '' END,
                                        '^([a-z]+://[^?#]*/)', 1) || replace(href[2:], '&amp;', '&') END AS url
        FROM page_link""",
    "valid_links": f"WITH {_LINKS} SELECT seq, pos, url FROM link WHERE trim(url) <> ''",
    "tokens": f"SELECT doc_id AS seq, array_to_string({_SPLIT}, ' ') AS words FROM documents",
    "clean_tokens": f"SELECT doc_id AS seq, array_to_string({_KEPT}, ' ') AS words FROM documents",
    "term_freq": f"WITH {_DOCS}, {_TERMS} SELECT seq, term, tf FROM tf",
    "doc_length": f"WITH {_DOCS}, {_TERMS} SELECT seq, len(kept)::INT AS len FROM words",
    "running_doc_count": f"WITH {_DOCS}, {_TERMS} SELECT seq, n AS doc_count FROM number",
    "running_term_freq": f"{_DOC_TAGS} SELECT seq, term, cf FROM counts",
    "corpus_stats": f"""WITH {_DOCS}, {_TERMS}
        SELECT term, sum(tf)::BIGINT AS cf, (SELECT count(*) FROM words) AS doc_count FROM tf GROUP BY term""",
    "tfidf_scores": f"{_DOC_TAGS} SELECT seq, term, round(score, 6) AS score FROM scores",
    "corpus_tfidf": f"""WITH {_DOCS}, {_TERMS},
        stats AS (SELECT term, sum(tf)::BIGINT AS cf FROM tf GROUP BY term)
        SELECT seq, term, round(tf / len * (ln((1 + (SELECT count(*) FROM words)) / (1 + cf)) + 1), 6) AS score
        FROM tf JOIN stats USING (term)""",
    "query_scores": f"""WITH {_DOCS}, {_TERMS},
        stats AS (SELECT term, sum(tf)::BIGINT AS cf FROM tf GROUP BY term),
        asked AS (SELECT item_id AS seq, unnest({_KEPT}) AS term FROM benchmark WHERE text <> ''),
        asked_tf AS (SELECT seq, term, count(*) AS tf FROM asked GROUP BY ALL),
        asked_len AS (SELECT seq, count(*) AS len FROM asked GROUP BY seq)
        SELECT seq, term,
               round(tf / len * (ln((1 + (SELECT count(*) FROM words)) / (1 + coalesce(cf, 0))) + 1), 6) AS score
        FROM asked_tf JOIN asked_len USING (seq) LEFT JOIN stats USING (term)""",
    "top3_tags": f"{_DOC_TAGS} SELECT seq, rank, term AS tag FROM ranked WHERE rank <= 3",
    "doc_tags": f"""{_DOC_TAGS}
        SELECT seq, docs.link, coalesce(string_agg(tag, ' ' ORDER BY rank), '') AS tags
        FROM docs LEFT JOIN tagged USING (seq) GROUP BY ALL""",
    "page_tags": f"{_PAGE_TAGS} SELECT seq, link, rank, tag FROM tagged",
    "text_hash": "SELECT doc_id AS seq, sha256(text) AS text_hash FROM documents",
    "text_dedup": "SELECT sha256(text) AS text_hash, min(doc_id) AS seq FROM documents GROUP BY text",
    "seen_link_dedup": f"WITH {_LINKS}, {_FIRSTS} SELECT {_FIRST_COLUMNS} FROM firsts",
    "frontier_queue": f"WITH {_LINKS}, {_FIRSTS} SELECT row_number() OVER (ORDER BY place) AS seq, url FROM firsts",
    "stored_link_check": f"""WITH {_LINKS}, {_FIRSTS}, {_STORED}
        SELECT {_FIRST_COLUMNS} FROM firsts WHERE url NOT IN (SELECT url FROM stored)""",
    "validation_report": f"""WITH {_DOCUMENT_LINKS},
        by_link AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS nth FROM rows),
        by_text AS (
          SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY seq) AS nth_text FROM by_link WHERE nth = 1),
        stored AS (SELECT url FROM rows JOIN labels ON doc_id = seq)
        SELECT l.seq, l.url,
               CASE WHEN l.nth > 1 THEN 'seen_link' WHEN t.nth_text > 1 THEN 'seen_text'
                    WHEN l.url IN (SELECT url FROM stored) THEN 'stored_link' END AS failed_stage
        FROM by_link l LEFT JOIN by_text t USING (seq)""",
    "crawl_frontier": f"""WITH {_LINKS}, {_FIRSTS}
        , {_PAGE_DOCS}
        SELECT seq, pos, url, NULL::VARCHAR AS text FROM (SELECT {_FIRST_COLUMNS} FROM firsts)
        WHERE url NOT IN (SELECT url FROM pages)
        UNION ALL SELECT seq, NULL, link, text FROM docs""",
    "crawl_reach": f"""WITH RECURSIVE graph AS (
          SELECT '{_BASE}/region/' || r_regionkey AS src, '{_BASE}/region/' || (r_regionkey + 1) % 5 AS url FROM region
          UNION ALL SELECT '{_BASE}/region/' || n_regionkey, '{_BASE}/nation/' || n_nationkey FROM nation
          UNION ALL SELECT '{_BASE}/nation/' || n_nationkey, '{_BASE}/region/' || n_regionkey FROM nation
          UNION ALL SELECT '{_BASE}/nation/' || c_nationkey, '{_BASE}/customer/' || c_custkey FROM customer
          UNION ALL SELECT '{_BASE}/nation/' || s_nationkey, '{_BASE}/supplier/' || s_suppkey FROM supplier
          UNION ALL SELECT '{_BASE}/customer/' || o_custkey, '{_BASE}/order/' || o_orderkey FROM orders),
        walk AS (
          SELECT '{_BASE}/region/0' AS url, 0 AS depth
          UNION SELECT graph.url, depth + 1 FROM walk JOIN graph ON src = walk.url
          WHERE depth < (SELECT count(DISTINCT src) FROM graph WHERE src NOT LIKE '%/customer/%'))
        SELECT url, min(depth) AS depth FROM walk GROUP BY url""",
    # No link leads to a stored page, so the queue is the pages in order with
    # what each round's pages hold appended.
    "crawl_budget": f"""WITH {_LINKS},
        start AS (SELECT row_number() OVER (ORDER BY page_id) AS seq, url FROM pages),
        found AS (
          SELECT link.url, min((start.seq * 1000000) + pos) AS place
          FROM link JOIN start ON start.url = link.src
          WHERE start.seq <= {q.BUDGET * q.ROUNDS} AND link.url NOT IN (SELECT url FROM start) GROUP BY link.url),
        queue AS (
          SELECT seq, url FROM start
          UNION ALL SELECT (SELECT count(*) FROM start) + row_number() OVER (ORDER BY place), url FROM found)
        SELECT ceil(seq / {q.BUDGET})::INT AS round, seq, url FROM queue WHERE seq <= {q.BUDGET * q.ROUNDS}""",
    "tag_index": f"{_DOC_TAGS} SELECT tag, link, count(*) AS popularity FROM tagged GROUP BY ALL",
    "tag_lookup": f"""{_DOC_TAGS}
        SELECT link, count(*) AS popularity FROM tagged WHERE tag IN ({_quoted([q.LOOKUP_TAG])}) GROUP BY ALL""",
    "links_dim": f"{_STAR} SELECT id, link FROM links",
    "tags_dim": f"{_STAR} SELECT id, tag FROM tags",
    "link_tag_junction": f"{_STAR} SELECT link_id, tag_id FROM junction",
    "cascade_delete": f"""{_STAR.replace("links AS", "all_links AS").replace("JOIN links", "JOIN all_links AS links")
        .replace("tags AS", "all_tags AS").replace("JOIN tags", "JOIN all_tags AS tags").replace("junction AS", "all_pairs AS")},
        links AS (SELECT * FROM all_links WHERE link NOT LIKE 'http://%'),
        tags AS (SELECT * FROM all_tags WHERE tag NOT IN ({_quoted(q.DELETED_TAGS)})),
        junction AS (
          SELECT * FROM all_pairs WHERE link_id IN (SELECT id FROM links) AND tag_id IN (SELECT id FROM tags))
        {_STAR_ROWS}""",
    "tag_search": f"{_STAR} SELECT DISTINCT tag, link FROM tagged WHERE tag IN ({_quoted(q.SEARCH_TAGS)})",
    "queue_pull": f"""WITH {_READABLE},
        taken AS (SELECT seq FROM readable ORDER BY seq LIMIT {q.QUEUE_LIMIT})
        SELECT seq, 'taken' AS state FROM taken
        UNION ALL SELECT seq, 'rest' FROM readable WHERE seq > (SELECT max(seq) FROM taken)
        UNION ALL SELECT seq - 1, 'rest' FROM readable WHERE turn = 0 AND seq - 1 > (SELECT max(seq) FROM taken)""",
    "queue_take": f"""WITH {_READABLE},
        placed AS (SELECT seq, conv_id, turn, row_number() OVER (ORDER BY seq) AS place FROM readable)
        SELECT CAST(least((place - 1) // {q.QUEUE_LIMIT}, 2) AS INTEGER) AS pull, seq, conv_id, turn FROM placed""",
    "queue_peek": f"""WITH {_READABLE}
        SELECT seq, conv_id, turn, role, text FROM readable ORDER BY seq LIMIT {q.QUEUE_LIMIT}""",
    "push_both": f"""WITH {_MESSAGES}
        SELECT 'list' AS place, seq, role AS value FROM numbered
        UNION ALL SELECT 'list', seq, role FROM numbered WHERE seq <= {q.QUEUE_LIMIT}
        UNION ALL SELECT 'set', NULL, role FROM (SELECT DISTINCT role FROM numbered)
        UNION ALL SELECT 'kept', seq, role FROM numbered WHERE seq > {q.QUEUE_LIMIT}""",
    "table_setup": f"{_STAR} {_STAR_ROWS}",
    "queue_push_json": f"""WITH {_MESSAGES}
        SELECT seq, conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text FROM numbered""",
    "set_push": f"WITH {_LINKS} SELECT DISTINCT url AS value FROM link",
    "snapshot_roundtrip": f"""{_PAGE_TAGS}, {_LINKS}, {_FIRSTS},
        queue AS (SELECT {_FIRST_COLUMNS} FROM firsts)
        SELECT 'queue' AS part, url AS key, seq || ':' || pos AS value FROM queue
        UNION ALL SELECT 'processed', url, '' FROM pages
        UNION ALL SELECT 'index', tag, count(*) || ' ' || link FROM tagged GROUP BY tag, link""",
    "crawl_rates": """WITH sightings AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id),
        ticks AS (
          SELECT ts, 1 AS viewed, 0 AS found FROM events WHERE event_type = 'view'
          UNION ALL SELECT ts, 0, 1 FROM sightings),
        hours AS (
          SELECT date_trunc('hour', ts) AS period, sum(viewed) AS viewed, sum(found) AS found FROM ticks GROUP BY ALL),
        running AS (
          SELECT period, sum(viewed) OVER w AS viewed, sum(found) OVER w AS found,
                 date_diff('microsecond', (SELECT min(ts) FROM ticks), period + INTERVAL 1 HOUR) / 1e6 AS elapsed
          FROM hours WINDOW w AS (ORDER BY period))
        SELECT period, viewed::BIGINT AS opened_links, found::BIGINT AS gathered_links,
               round_even(viewed::DOUBLE / elapsed * 100, 0) / 100 AS view_rate,
               round_even(found::DOUBLE / elapsed * 100, 0) / 100 AS gather_rate
        FROM running""",
}
ORACLES["stream_seen_links"] = ORACLES["stream_seen_links_keyed"] = ORACLES["seen_link_dedup"]
ORACLES["crawl_resume"], ORACLES["crawl_budget_resume"] = ORACLES["crawl_reach"], ORACLES["crawl_budget"]
ORACLES["stream_validation"] = f"""WITH {_DOCUMENT_LINKS},
    fresh AS (SELECT * FROM rows WHERE url NOT IN (SELECT url FROM rows JOIN labels ON doc_id = seq)),
    by_link AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS nth FROM fresh),
    by_text AS (
      SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY seq) AS nth_text FROM by_link WHERE nth = 1)
    SELECT seq, url FROM by_text WHERE nth_text = 1"""
ORACLES["stream_doc_tags"] = f"{_DOC_TAGS} SELECT seq, link, rank, tag FROM tagged"
ORACLES["stream_link_tags"] = f"{_STAR} SELECT DISTINCT tag, link FROM tagged"
ORACLES["stream_tag_index"] = ORACLES["tag_index"]
# What the first batch left after the deletes, and all of the second.
ORACLES["stored_cascade_delete"] = f"""{_PAGE_TAGS}
    SELECT DISTINCT tag, link FROM tagged
    WHERE seq % 2 = 1 OR (tag NOT IN ({_quoted(q.DELETED_TAGS)}) AND link NOT IN (SELECT link FROM tagged WHERE seq % 4 = 0))"""
