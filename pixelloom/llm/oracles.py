"""SQL that says what the numbered queries return, where SQL can say it on whole tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages), h AS (SELECT d, min(page_id) AS head FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN head <> page_id THEN head END AS refers_to FROM p LEFT JOIN h USING (d)"""

OP2 = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM s), r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM k) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM r, range(0, 35) t(o)), word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP5 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)), way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT w.b, r.root FROM r JOIN way w ON w.a = r.doc_id), least AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)"""

OP6 = """WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents), k AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM k) WHERE c > 1), e AS (SELECT doc_id, i, i > 200 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM r),
f AS (SELECT doc_id, i, sum(CASE WHEN coalesce(gap, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM e), span AS (SELECT doc_id, s, min(i) AS a, max(i) + 200 AS b FROM f GROUP BY 1, 2),
edge AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span), part AS (SELECT doc_id, before AS a, a AS b FROM edge UNION ALL SELECT doc_id, max(b), NULL FROM span GROUP BY 1),
kept AS (SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS h FROM part JOIN d USING (doc_id) GROUP BY 1),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM span GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP7 = f"""WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents), b AS (SELECT item_id, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
p AS (SELECT item_id, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0), pat AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM p), size AS (SELECT DISTINCT n FROM pat),
s AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, size WHERE len(w) >= n), hit AS (SELECT doc_id, i, s.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM s) s JOIN pat USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hit, range(0, 13) t(o) WHERE o < n GROUP BY 1), found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP8 = """SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents"""

OP11 = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN link l ON l.a = r.vec_id), least AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)"""

_STEP = "{{'c': {cost} + {v}.c, 'e': '{edit}' || {v}.e, 'r': {line} || CASE WHEN {v}.r = '' THEN '' ELSE chr(10) || {v}.r END}}"
_NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))  # what follows nothing, s, u and a


def _row_edits(q: int) -> str:
    """The least of the edits of a row in state q; v holds what follows it."""
    t, role = _NEXT[q]
    drop = f"{{'c': 4 + v[{q + 1}].c, 'e': 'D' || v[{q + 1}].e, 'r': v[{q + 1}].r}}"
    name = _STEP.format(cost="3 + m", edit="R", line=f"'{role}:' || text", v=f"v[{t + 1}]")
    keep = _STEP.format(cost="m", edit="K", line="role || ':' || text", v=f"v[{t + 1}]")
    out = f"[{drop}] || CASE WHEN fault IN (1, 2) THEN [] ELSE [{name}] END || CASE WHEN fault IN (1, 2) OR left(role, 1) <> '{role[0]}' THEN [] ELSE [{keep}] END"
    if q == 0:
        out += f" || CASE WHEN fault IN (1, 2) OR left(role, 1) <> 's' THEN [] ELSE [{_STEP.format(cost='m', edit='K', line=chr(39).join(['role || ', ':', ' || text']), v='v[2]')}] END"
    return f"list_min({out})"


def _inserts(q: int) -> str:
    """The least of none, one and two inserts in state q before the edits b of a row."""
    t, role = _NEXT[q]
    u, other = _NEXT[t]
    one = _STEP.format(cost=3, edit="I", line=f"'{role}:'", v=f"b[{t + 1}]")
    two = _STEP.format(cost=6, edit="II", line=f"'{role}:' || chr(10) || '{other}:'", v=f"b[{u + 1}]")
    return f"list_min([b[{q + 1}], {one}, {two}])"


_END = "[{'c': 0, 'e': '', 'r': ''}, {'c': 6, 'e': 'II', 'r': 'user:' || chr(10) || 'assistant:'}, {'c': 3, 'e': 'I', 'r': 'assistant:'}, {'c': 0, 'e': '', 'r': ''}]"
OP12 = f"""WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
c AS (SELECT conv_id, coalesce('v' || conv_id, 'n') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
k AS (SELECT c.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(s, ''), lambda ch: ord(ch)::BIGINT)), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS k FROM c, tab),
r AS (SELECT conv, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail FROM r),
f AS (SELECT conv, i, turn, role, text, CASE WHEN tail = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) || left(role, 1) AS pair FROM o),
w AS (SELECT conv, max(i) AS i, {_END} AS v FROM f GROUP BY conv UNION ALL
SELECT conv, i - 1, [{", ".join(_inserts(q) for q in range(4))}] FROM (SELECT conv, i, [{", ".join(_row_edits(q) for q in range(4))}] AS b FROM (SELECT f.*, v, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS m FROM w JOIN f USING (conv, i)))),
g AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v[1].c, 0)::BIGINT AS cost, coalesce(v[1].e, '') AS audit, sha256(coalesce(v[1].r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM c) n LEFT JOIN g USING (conv) LEFT JOIN (SELECT conv, v FROM w WHERE i = 0) USING (conv)"""

OP13 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT doc_id, t, u, len(u) AS n, list_transform(range(0, 4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::UBIGINT) AS h FROM d),
c AS (SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

SQL = {"op1_warc": OP1, "op2_substring_dedup": OP2, "op5_minhash_near_dedup": OP5, "op6_suffix_dedup": OP6, "op7_decontamination": OP7, "op8_exact_dedup": OP8, "op11_embedding_near_dedup": OP11, "op12_conversation_repair": OP12, "op13_fill_in_middle": OP13}
