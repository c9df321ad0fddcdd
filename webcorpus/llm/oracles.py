"""The operators that plain SQL can say, for DuckDB over the same tables."""

#: Words of op2 and op4, and of op6 after lower-casing.
_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP2 = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
    repeated AS (SELECT win FROM win GROUP BY win HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM win SEMI JOIN repeated USING (win)),
    word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
    removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""

OP4 = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    word AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS b,
                    CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS c
             FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
    -- What is left of each count without the document's own occurrences.
    one AS (SELECT doc_id, a, (sum(count(*)) OVER (PARTITION BY a) - count(*))::BIGINT AS n FROM word GROUP BY doc_id, a),
    two AS (SELECT doc_id, b, (sum(count(*)) OVER (PARTITION BY b) - count(*))::BIGINT AS n FROM word WHERE b IS NOT NULL GROUP BY doc_id, b),
    three AS (SELECT doc_id, c, (sum(count(*)) OVER (PARTITION BY c) - count(*))::BIGINT AS n FROM word WHERE c IS NOT NULL GROUP BY doc_id, c),
    counted AS (SELECT doc_id, i, one.n AS n1, two.n AS n2, three.n AS n3,
                       lag(one.n) OVER place AS p1, lag(two.n) OVER place AS p2, (SELECT count(*) FROM word) - count(*) OVER (PARTITION BY doc_id) AS others
                FROM word JOIN one USING (doc_id, a) LEFT JOIN two USING (doc_id, b) LEFT JOIN three USING (doc_id, c)
                WINDOW place AS (PARTITION BY doc_id ORDER BY i)),
    scored AS (SELECT doc_id, CASE WHEN n3 > 0 THEN ln(n3 / p2) WHEN n2 > 0 THEN ln(n2 / p1) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
                      ELSE CASE WHEN n1 > 0 THEN ln(n1 / others) ELSE -ln(others + 1) END + ln(0.4) * (least(i, 3) - 1) END AS s FROM counted),
    total AS (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(s, 0.0), 3) AS log_score,
           CASE WHEN len(w) > 0 THEN round(s / len(w), 4) END AS log_per_word
    FROM d LEFT JOIN total USING (doc_id)"""

OP5 = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
    first AS (SELECT win, min(doc_id) AS first FROM win GROUP BY win HAVING count(*) > 1),
    starts AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following,
                      lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
               FROM win JOIN first USING (win) WHERE first < doc_id),
    -- Each start removes its 50 bytes, or those up to the next start.
    parts AS (SELECT doc_id, i AS a, least(i + 50, coalesce(following, i + 50)) AS b, before IS NULL OR before + 50 < i AS fresh FROM starts),
    runs AS (SELECT doc_id, a, b, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM parts),
    spans AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM runs GROUP BY doc_id, run),
    gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
             UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
    kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
    removed AS (SELECT doc_id, sum(b - a)::BIGINT AS n, count(*) AS spans FROM spans GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept, h))) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""

OP6 = f"""
    WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
    item AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
    here AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
             FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win))),
    met AS (SELECT doc_id, i, size, item_id FROM here JOIN win USING (win, size)),
    hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM met) GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM met) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP11 = f"""
    WITH piece AS (SELECT coalesce(lang, 'und') AS lang,
                          unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    d AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM piece),
    gram AS (SELECT lang, m, w[i:i + m - 1] AS g
             FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT unnest([1, 2, 3, 4]) AS m))),
    f AS (SELECT lang, m, g, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 30),
    total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM d GROUP BY lang),
    cut AS (SELECT c.lang, c.m, c.g, c.f AS a, h.m AS k, h.f AS l, t.f AS r,
                   ((2000000::HUGEINT * c.f) // (h.f + t.f))::BIGINT AS score
            FROM f c JOIN f h ON c.lang = h.lang AND h.g = c.g[1:h.m] AND h.m < c.m
                     JOIN f t ON c.lang = t.lang AND t.g = c.g[h.m + 1:c.m] WHERE c.m > 1),
    best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    inner_part AS (SELECT lang, f, g[s:s + k - 1] AS g
                   FROM (SELECT lang, f, m, g, k, unnest(range(1, m - k + 2)) AS s FROM f, (SELECT unnest([2, 3]) AS k) WHERE m > 2 AND k < m)),
    longer AS (SELECT lang, g, max(f) AS f FROM inner_part GROUP BY ALL),
    kept AS (SELECT best.*, array_to_string(best.g, ' ') AS phrase FROM best LEFT JOIN longer USING (lang, g)
             WHERE longer.f IS NULL OR 100 * longer.f < 80 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""

OP12 = f"""
    WITH term AS (SELECT doc_id, unnest({_ITEM_WORDS}) AS term FROM documents),
    doc AS (SELECT doc_id, count(*) AS n FROM term GROUP BY doc_id),
    total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM doc),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM term GROUP BY ALL),
    asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_ITEM_WORDS}) AS term FROM benchmark) GROUP BY ALL),
    weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
               FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
    part AS (SELECT item_id, doc_id, q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS s
             FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN doc USING (doc_id), total),
    scored AS (SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM part GROUP BY ALL HAVING sum(s) > 0)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scored QUALIFY rank <= 10"""

#: Pages of the given tables mark their article as such, so SQL can cut it out; others need the operator.
OP13 = r"""
    WITH cut AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '') AS body FROM pages),
    line AS (SELECT page_id, url, unnest(string_split(regexp_replace(regexp_replace(body, '[ \t\r\n]+', ' ', 'g'), '</?(p|h1)( [^>]*)?>', chr(10), 'g'), chr(10))) AS line,
                    unnest(range(1, len(string_split(regexp_replace(regexp_replace(body, '[ \t\r\n]+', ' ', 'g'), '</?(p|h1)( [^>]*)?>', chr(10), 'g'), chr(10))) + 1)) AS pos FROM cut),
    bare AS (SELECT page_id, url, pos, trim(regexp_replace(replace(replace(replace(replace(replace(
                 regexp_replace(regexp_replace(line, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
                 '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS line FROM line)
    SELECT page_id, url, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (line <> ''), '') AS text,
           length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (line <> ''), ''))::BIGINT AS n_chars
    FROM bare GROUP BY page_id, url"""
