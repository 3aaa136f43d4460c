"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from panelspark.llm import mixing, packing, url_filter

WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"


def url_filter_sql() -> str:
    host = "translate(regexp_extract({0}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract({0}, '^[^/?#]*([^?#]*)', 1)"
    query = "regexp_extract({0}, '^[^?#]*([?][^#]*)', 1)"
    rule = "CASE " + " ".join(
        f"WHEN ({{h}} = '{r.host}' OR ends_with({{h}}, '.{r.host}')) AND starts_with({{p}}, '{r.path}') THEN '{{{r.verdict}}}{r.name}'"
        for r in sorted(url_filter.RULES, key=lambda r: -len(r.name))) + " END"
    rule = rule.replace("{allow}", "allow ").replace("{block}", "block ")

    def key(rest: str) -> str:
        h = host.format(rest)
        return f"CASE WHEN {h} <> '' THEN {h} || {path.format(rest)} || {query.format(rest)} END"

    def named(tag: str, attribute: str) -> str:
        """Links are taken apart into what they change: all, host and path, path, last segment, query."""
        link = f"replace(regexp_extract(regexp_extract(html, '{tag}', 0), '{attribute}', 1), '&amp;', '&')"
        segments = "string_split(p, '/')[2:]"
        walked = (f"array_to_string(list_reduce(list_prepend([]::varchar[], list_transform({segments}, lambda s: [s])), lambda k, s: "
                  "CASE s[1] WHEN '.' THEN k WHEN '..' THEN k[:greatest(len(k) - 1, 0)] ELSE list_concat(k, s) END), '/')")
        tidy = (f"CASE WHEN contains(p, '/.') THEN list_transform([{walked}], lambda w: '/' || w || "
                "CASE WHEN w <> '' AND regexp_matches(p, '/[.][.]?$') THEN '/' ELSE '' END)[1] ELSE p END")
        return f"""(SELECT CASE WHEN h <> '' THEN h || {tidy} || q END FROM (
            SELECT CASE kind WHEN 'all' THEN {host.format("substr(l, strpos(l, '://') + 3)")} WHEN 'host' THEN {host.format('substr(l, 3)')} ELSE host END AS h,
                   CASE kind WHEN 'all' THEN {path.format("substr(l, strpos(l, '://') + 3)")} WHEN 'host' THEN {path.format('substr(l, 3)')}
                             WHEN 'path' THEN regexp_extract(l, '^([^?#]*)', 1) WHEN 'query' THEN path
                             WHEN 'near' THEN coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || regexp_extract(l, '^([^?#]*)', 1) END AS p,
                   {query.format("CASE kind WHEN 'all' THEN substr(l, strpos(l, '://') + 3) WHEN 'host' THEN substr(l, 3) ELSE l END")} AS q
            FROM (SELECT l, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'all' WHEN starts_with(l, '//') THEN 'host'
                                 WHEN l = '' OR starts_with(l, '#') OR regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                                 WHEN starts_with(l, '/') THEN 'path' WHEN starts_with(l, '?') THEN 'query' ELSE 'near' END AS kind
                  FROM (SELECT {link} AS l)) WHERE kind IS NOT NULL))"""

    quote = lambda s: s.replace("'", "''")
    return f"""
WITH RECURSIVE rests AS (SELECT page_id, html, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
parts AS (SELECT page_id, html, rest, {host.format('rest')} AS host, {path.format('rest')} AS path, {query.format('rest')} AS query FROM rests),
urls AS (
    SELECT page_id, host, path, {key('rest')} AS key,
           CASE WHEN host <> '' THEN regexp_replace(host, '{url_filter.HOST_PREFIX}', '') || regexp_replace(path, '{url_filter.PATH_END}', '')
                || regexp_replace(regexp_replace(query, '{url_filter.TRACKING}', '', 'g'), '^&', '?') END AS landing,
           {named(quote(url_filter.CANONICAL), quote(url_filter.HREF))} AS canonical,
           {named(quote(url_filter.REFRESH), quote(url_filter.REFRESH_URL))} AS refresh
    FROM parts),
links AS (SELECT key AS a, landing AS b FROM urls UNION SELECT key, canonical FROM urls UNION SELECT key, refresh FROM urls),
edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT a AS node, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON r.node = e.a),
members AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
decided AS (
    SELECT component, min(split_part(found, ' ', 1)) AS verdict
    FROM (SELECT component, {rule.format(h=host.format('node'), p=path.format('node'))} AS found FROM members)
    WHERE found IS NOT NULL GROUP BY component),
ruled AS (SELECT page_id, host, path, key, {rule.format(h='host', p='path')} AS found FROM urls)
SELECT r.page_id, r.host, r.path, split_part(r.found, ' ', 2) AS rule,
       coalesce(split_part(r.found, ' ', 1), d.verdict, 'allow') AS verdict
FROM ruled r LEFT JOIN members m ON r.key = m.node LEFT JOIN decided d ON m.component = d.component"""


def _content_hash(seed: int) -> str:
    return f"md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')))"


def packing_sql(buckets: int = packing.BUCKETS, budget: int = packing.TOKEN_BUDGET) -> str:
    """Dynamic programming as one table for each number of buckets, then the way back."""
    forward = "".join(f""",
f{k} AS MATERIALIZED (
    SELECT b.j, coalesce(min([a.cost + b.longest * (b.upto - a.upto), a.j]), [b.longest * b.upto, 0]) AS best
    FROM h b LEFT JOIN (SELECT f.j, f.best[1] AS cost, h.upto FROM f{k - 1} f JOIN h USING (j)) a ON a.j < b.j GROUP BY b.j, b.longest, b.upto)"""
                      for k in range(2, buckets + 1))
    back = f",\ne{buckets} AS (SELECT max(j) AS j FROM h)" + "".join(f""",
e{k - 1} AS (SELECT f.best[2] AS j FROM e{k} e JOIN f{k} f USING (j) WHERE e.j > 0)""" for k in range(buckets, 1, -1))
    ends = " UNION ".join(f"SELECT j FROM e{k}" for k in range(1, buckets + 1))
    return f"""
WITH t AS MATERIALIZED (SELECT doc_id, CAST({WORDS} AS BIGINT) AS n_tokens, {_content_hash(31)} AS ord FROM documents),
cells AS (SELECT n_tokens AS cell, n_tokens AS longest, count(*) AS n FROM t GROUP BY 1),
h AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY cell) - 1 AS BIGINT) AS j, longest, CAST(sum(n) OVER (ORDER BY cell) AS BIGINT) AS upto FROM cells),
f1 AS (SELECT j, [longest * upto, 0] AS best FROM h){forward}{back},
ends AS MATERIALIZED (SELECT DISTINCT longest FROM h JOIN ({ends}) USING (j)),
placed AS (
    SELECT doc_id, n_tokens, ord, (SELECT count(*) FROM ends WHERE longest < n_tokens) AS bucket,
           (SELECT min(longest) FROM ends WHERE longest >= n_tokens) AS padded_to
    FROM t),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ord, doc_id) - 1 AS rank,
           greatest(1, {budget} // greatest(padded_to, 1)) AS size
    FROM placed)
SELECT doc_id, n_tokens, CAST(bucket AS INTEGER) AS bucket, padded_to, CAST(rank // size AS BIGINT) AS batch,
       CAST(rank % size AS BIGINT) AS place
FROM ranked"""


def mixing_sql(rounds: int = 40) -> str:
    form = "CASE " + " ".join(f"WHEN n_tokens < {n} THEN '{name}'" for n, name in mixing.FORMS) + f" ELSE '{mixing.LONGEST}' END"
    margins = mixing.MARGINS
    names = ", ".join(margins)
    levels = ",\n".join(f"""o_{m} AS (
    SELECT {m}, tok, share, sum(tok) OVER up - tok AS full_, sum(share) OVER (ORDER BY tok / share DESC, {m} DESC) AS open_
    FROM (SELECT {m}, sum(tokens) AS tok, power(sum(tokens), {mixing.TEMPER}) AS share FROM cells GROUP BY {m})
    WINDOW up AS (ORDER BY tok / share, {m})),
g_{m} AS (SELECT {m}, least(tok, share * (SELECT max(({mixing.BUDGET} * (SELECT sum(tokens) FROM cells) - full_) / open_) FROM o_{m})) AS g_{m} FROM o_{m})"""
                          for m in margins)
    keep = ", ".join(f"g_{m}" for m in margins)
    joins = " ".join(f"JOIN g_{m} USING ({m})" for m in margins)
    steps, last = [], "goals"
    for k in range(rounds):
        for m in margins:
            steps.append(f"w{k}_{m} AS (SELECT {names}, tokens, {keep}, least(tokens, w * g_{m} / sum(w) OVER (PARTITION BY {m})) AS w FROM {last})")
            last = f"w{k}_{m}"
    chain = ",\n".join(steps)
    draw = f"CAST('0x' || substr({_content_hash(23)}, 1, 12) AS BIGINT) / {float(16**12)}"
    return f"""
WITH n AS MATERIALIZED (
    SELECT doc_id, coalesce(source, '{mixing.MISSING}') AS source, coalesce(lang, '{mixing.MISSING}') AS lang,
           greatest(CAST({WORDS} AS BIGINT), 1) AS n_tokens, {draw} AS draw
    FROM documents),
t AS (SELECT *, {form} AS topic FROM n),
cells AS MATERIALIZED (SELECT {names}, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM t GROUP BY ALL),
{levels},
goals AS MATERIALIZED (SELECT {names}, tokens, tokens AS w, {keep} FROM cells {joins}),
{chain},
rates AS MATERIALIZED (SELECT {names}, w / tokens AS rate FROM {last})
SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS rate, draw < rate AS taken
FROM t JOIN rates USING ({names})"""


def warc_sql() -> str:
    host = "regexp_replace(translate(regexp_extract({0}, '^([^/?#]*)', 1), '" + url_filter.UPPER + "', '" + url_filter.LOWER + "'), '^www[.]|:(80|443)$', '')"
    rest = "regexp_extract(url, '(?s)^.*?://(.*)$', 1)"
    h = host.format(rest)
    key = (f"CASE WHEN {h} <> '' THEN {h} || regexp_replace(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '/$', '') "
           f"|| regexp_extract({rest}, '^[^?#]*([?][^#]*)', 1) END")
    return f"""
WITH base AS (SELECT page_id, url, md5(coalesce(html, '')) AS d, page_id * 1000 AS t0 FROM pages),
marked AS (
    SELECT *, substr(d, 1, 1) AS x, '"' || substr(d, 1, 16) || '"' AS first, '"' || substr(d, 17, 16) || '"' AS second,
           'day ' || page_id AS changed
    FROM base),
responses AS (
    SELECT 'a' || page_id AS response_id, url, t0 AS ts, first AS etag, changed FROM marked
    UNION ALL SELECT 'b' || page_id, url, t0 + 200, second, changed FROM marked WHERE x IN ('5', '6')),
revisits AS (
    SELECT page_id, url || '#again' AS url, CASE WHEN x = '4' THEN t0 - 500 ELSE t0 + 500 END AS ts,
           CASE WHEN x = '0' THEN '"other"' WHEN x IN ('1', '2', '7') THEN NULL WHEN x = '3' THEN 'W/' || first
                WHEN x IN ('5', '6') THEN second ELSE first END AS etag,
           CASE WHEN x = '1' THEN NULL WHEN x = '7' THEN 'day 0' ELSE changed END AS changed
    FROM marked),
r AS (SELECT *, {key} AS key FROM responses), v AS (SELECT *, {key} AS key FROM revisits),
latest AS (
    SELECT v.*, r.response_id, r.ts AS response_ts, r.etag AS old_etag, r.changed AS old_changed,
           row_number() OVER (PARTITION BY v.page_id, v.ts ORDER BY r.ts DESC NULLS LAST, r.response_id DESC) AS k
    FROM v LEFT JOIN r ON v.key = r.key AND r.ts < v.ts),
judged AS (
    SELECT *, CASE WHEN response_id IS NULL THEN 'unresolved' WHEN etag IS NULL AND changed IS NULL THEN 'no_validator'
                   WHEN CASE WHEN etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = old_etag ELSE changed = old_changed END
                   THEN 'resolved' ELSE 'validator_mismatch' END AS status
    FROM latest WHERE k = 1)
SELECT page_id, url, ts, status, CASE WHEN status = 'resolved' THEN response_id END AS response_id,
       CASE WHEN status = 'resolved' THEN response_ts END AS response_ts,
       CASE WHEN status = 'resolved' THEN CAST(6 AS BIGINT) END AS n_headers,
       CASE WHEN status = 'resolved' THEN 'max-age=60' END AS cache_control,
       CASE WHEN status = 'resolved' THEN 'text/html' END AS content_type,
       CASE WHEN status = 'resolved' THEN CAST(ts AS VARCHAR) END AS date,
       CASE WHEN status = 'resolved' THEN coalesce(etag, old_etag) END AS etag,
       CASE WHEN status = 'resolved' THEN coalesce(changed, old_changed) END AS last_modified,
       CASE WHEN status = 'resolved' THEN 'origin' END AS server
FROM judged"""
