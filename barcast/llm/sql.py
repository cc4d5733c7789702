"""SQL counterparts of the text queries, where SQL can express them."""

_LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
     l AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM d),
     w AS (SELECT doc_id, pos, line AS a,
                  lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c
           FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
     r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth
           FROM w WHERE c IS NOT NULL),
     x AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (VALUES (0), (1), (2)) v(k) WHERE nth > 1),
     k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS kept, count(*) AS n
           FROM l ANTI JOIN x USING (doc_id, pos) GROUP BY l.doc_id)
SELECT d.doc_id, len(lines)::BIGINT AS n_lines, len(lines) - coalesce(k.n, 0)::BIGINT AS n_removed,
       length(coalesce(kept, ''))::BIGINT AS n_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_CONTAMINATION = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bx AS (SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM bw WHERE len(w) > 0),
     win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM bx),
     sizes AS (SELECT DISTINCT n FROM win),
     dx AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n),
     occ AS (SELECT DISTINCT doc_id, p, win.n, item_id FROM dx JOIN win ON win.n = dx.n AND win.s = array_to_string(w[p:p + dx.n - 1], ' ')),
     hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM occ) GROUP BY doc_id),
     item AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(coalesce(w, []))::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(coalesce(w, [])) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""

_JACCARD = r"""
WITH RECURSIVE t AS (
         SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS g
           FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS p FROM t WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
     e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
     r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
SELECT r.doc_id, any_value(coalesce(n.n, 0))::BIGINT AS n_shingles, min(reached) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""


_FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS x FROM documents),
     u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
                  ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
     c AS (SELECT doc_id, text, w, len(w)::BIGINT AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                       WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
     p AS (SELECT doc_id, n, form, text, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(pre || mid || suf) AS restored_sha256
FROM p
"""


def oracle() -> dict[str, str]:
    return {
        "op2_decontamination": _CONTAMINATION,
        "op5_line_dedup": _LINE_DEDUP,
        "op9_jaccard_join": _JACCARD,
        "op11_fill_in_middle": _FILL_IN_MIDDLE,
    }
