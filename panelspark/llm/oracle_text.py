"""SQL for the manifest and the repair of conversations, in the dialect of the checker."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text: a fold over its characters with the table of the polynomial."""
    table = []
    for entry in range(256):
        for _ in range(8):
            entry = entry >> 1 ^ (0xEDB88320 if entry & 1 else 0)
        table.append(entry)
    return (
        f"xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), "
        f"lambda c: ascii(c)::bigint)), lambda h, b: xor(h >> 8, ({table}::bigint[])[(xor(h, b) & 255) + 1])))")


def merkle_sql(arity: int = 16, height: int = 6) -> str:
    """Trees of up to ``arity ** height`` leaves; a group that has come down to one node keeps it."""
    def coded(c):
        return f"coalesce(strlen(({c})::varchar)::varchar || ':' || ({c})::varchar, '-')"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(coded(c) for c in ("doc_id", "source", "lang", "n_chars"))
    parts = [f"""
docs AS (
  SELECT doc_id, coalesce('=' || source, '-') AS grp, sha256({head} || {coded('text')}) AS leaf,
         CASE WHEN {crc32_sql('doc_id::varchar')} % 5 = 0 THEN sha256({head} || {coded(lowered)}) END AS tampered
  FROM documents),
a0 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM docs),
n0 AS (SELECT grp, idx, leaf AS digest FROM a0)"""]

    def levels(tag):
        for k in range(1, height + 1):
            parts.append(f"""
{tag}{k} AS (
  SELECT grp, up AS idx, list(digest ORDER BY idx) AS run, max(many) AS many,
         CASE WHEN max(many) THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE max(digest) END AS digest
  FROM (SELECT grp, idx, digest, idx // {arity} AS up, count(*) OVER (PARTITION BY grp) > 1 AS many
        FROM {tag}{k - 1}) GROUP BY grp, up)""")

    levels("n")
    parts.append(f"""
t0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, digest, grp AS name FROM n{height})""")
    levels("t")

    def steps(tag):
        joins = " ".join(
            f"JOIN {tag}{k} {tag}x{k} ON {tag}x{k}.grp = {tag}.grp AND {tag}x{k}.idx = {tag}.idx // {arity ** k}"
            for k in range(1, height + 1))
        entries = ", ".join(
            f"CASE WHEN {tag}x{k}.many THEN {{'b': array_to_string({tag}x{k}.run[:slot({tag}.idx, {k})], ''), "
            f"'a': array_to_string({tag}x{k}.run[slot({tag}.idx, {k}) + 2:], '')}} END".replace(
                f"slot({tag}.idx, {k})", f"(({tag}.idx // {arity ** (k - 1)}) % {arity})::int")
            for k in range(1, height + 1))
        return joins, f"list_filter([{entries}], lambda e: e IS NOT NULL)"

    (n_joins, n_path), (t_joins, t_path) = steps("n"), steps("t")
    parts.append(f"tops AS (SELECT name, digest AS subroot, path, root FROM (SELECT t.name, t.digest, {t_path} AS path, "
                 f"tx{height}.digest AS root FROM t0 t {t_joins}))")
    parts.append(f"paths AS (SELECT n.doc_id, n.leaf, n.tampered, tops.subroot, tops.root, "
                 f"list_concat({n_path}, tops.path) AS path FROM a0 n {n_joins} JOIN tops ON tops.name = n.grp)")
    return "WITH " + ",".join(parts) + """
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (
  SELECT doc_id, leaf, subroot, root,
         sha256(coalesce(array_to_string(list_transform(path, lambda e: e.b || e.a), ''), '')) AS proof_sha256,
         list_reduce(list_prepend({'b': coalesce(tampered, leaf), 'a': ''}, path),
                     lambda x, e: {'b': sha256(e.b || x.b || e.a), 'a': ''}).b AS folded_root
  FROM paths)"""


def conversations_sql() -> str:
    """The repair as a recursive query that takes one row of every conversation a round.

    Each of four states keeps its least (cost, audit, repaired text); texts are compared as they are.
    """
    sp = "[ \\t\\n\\x0B\\f\\r]"
    follows = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}
    ways: dict[int, list[str]] = {q: [] for q in range(4)}

    def way(q, p, edits, extra, body):
        """A struct from state p; body: SQL for what is appended to the repaired text."""
        return f"{{'c': s{p}.c + {extra}, 'a': s{p}.a || '{edits}', 't': s{p}.t || {body}}}"

    for p in range(4):
        ways[p].append(f"CASE WHEN s{p}.c IS NOT NULL THEN {way(p, p, 'D', 2, chr(39) * 2)} END")
        state, edits, body, cost = p, "", "''", 0
        for _ in range(3):
            fresh = state == 0

            def line(role, text, fresh=fresh, body=body):
                return f"{body} || {chr(39) * 2 if fresh else 'chr(10)'} || {role} || ':' || {text}"

            ok = f"s{p}.c IS NOT NULL AND NOT doomed"
            if fresh:
                ways[1].append(f"CASE WHEN {ok} AND start = 's' THEN {way(1, p, edits + 'K', f'{cost} + broken', line('role', 'text'))} END")
            q = follows[state]
            ways[q].append(f"CASE WHEN {ok} AND start = '{name[q][0]}' THEN {way(q, p, edits + 'K', f'{cost} + broken', line('role', 'text'))} END")
            renamed = line(f"'{name[q]}'", "text")
            ways[q].append(f"CASE WHEN {ok} THEN {way(q, p, edits + 'R', f'{cost + 1} + broken', renamed)} END")
            body = line(f"'{name[q]}'", "''")
            edits, cost, state = edits + "I", cost + 5, q
    states = ", ".join(f"list_min(list_filter([{', '.join(ways[q])}], lambda w: w IS NOT NULL)) AS s{q}" for q in range(4))
    ends = ["s0", "s3", "{'c': s2.c + 5, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'}",
            "{'c': s1.c + 10, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}"]
    kind = "struct(c bigint, a varchar, t varchar)"
    none = f"CAST(NULL AS {kind})"
    return f"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 AS h
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         regexp_replace(text, '{sp}+$', '') AS solid, left(role, 1) AS start
  FROM hurt),
judged AS (
  SELECT *, solid = '' AS blank, solid <> '' AND again AS duplicate,
         solid <> '' AND NOT again AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated,
         coalesce((lag(start) OVER (PARTITION BY conv_id ORDER BY pos) || start) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM seen),
steps AS (
  SELECT conv_id, pos, role, text, start, blank OR duplicate AS doomed, CASE WHEN truncated THEN 5 ELSE 0 END AS broken
  FROM judged),
walk AS (
  SELECT conv_id, 0::bigint AS pos, CAST({{'c': 0, 'a': '', 't': ''}} AS {kind}) AS s0, {none} AS s1, {none} AS s2, {none} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, r.pos, w.s0, w.s1, w.s2, w.s3 FROM (
    SELECT conv_id, pos, {states} FROM (
      SELECT r.*, w.s0, w.s1, w.s2, w.s3 FROM walk w JOIN steps r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1)
  ) w JOIN steps r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos),
best AS (
  SELECT conv_id, list_min(list_filter([{', '.join(ends)}], lambda w: w.c IS NOT NULL)) AS w
  FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal
  FROM judged GROUP BY 1)
SELECT b.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank,
       coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated,
       coalesce(illegal, 0)::bigint AS illegal, w.c::bigint AS cost, w.a AS audit, sha256(w.t) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id"""
